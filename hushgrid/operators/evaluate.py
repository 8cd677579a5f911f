"""Accuracy of detections against gold spans, and fidelity of synthetic tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(ratio(2 * p * r, p + r), 6), "f2": F.round(ratio(5 * p * r, 4 * p + r), 6)}


def candidate_pairs(pred: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """Predictions and gold spans of one type and case that share ``least`` of the longer one."""
    p, g = pred.alias("p"), gold.alias("g")
    same = (F.col("p.case_id") == F.col("g.case_id")) & (F.col("p.entity_type") == F.col("g.entity_type"))
    common = F.least("p.char_end", "g.char_end") - F.greatest("p.char_start", "g.char_start")
    longer = F.greatest(F.col("p.char_end") - F.col("p.char_start"), F.col("g.char_end") - F.col("g.char_start"))
    joined = p.join(g, same & (F.col("p.char_start") < F.col("g.char_end")) & (F.col("g.char_start") < F.col("p.char_end")))
    return joined.filter(common / longer >= least).select("p.case_id", "p.entity_type", F.col("p.char_start").alias("p_start"), F.col("p.char_end").alias("p_end"), F.col("g.char_start").alias("g_start"), F.col("g.char_end").alias("g_end"), common.alias("overlap"))


def match(pairs: DataFrame) -> DataFrame:
    """One-to-one matches, greedily by overlap. A case's pairs make one row, so cases go through in Arrow batches."""
    span = "struct<entity_type:string,p_start:bigint,p_end:bigint,g_start:bigint,g_end:bigint,overlap:bigint>"
    kind = pa.list_(pa.struct([("entity_type", pa.string()), *[(n, pa.int64()) for n in ("p_start", "p_end", "g_start", "g_end", "overlap")]]))

    def greedy(rows: list[dict]) -> list[dict]:
        used, out = set(), []
        for r in sorted(rows, key=lambda r: (-r["overlap"], r["p_start"], r["g_start"], r["entity_type"])):
            p, g = ("p", r["entity_type"], r["p_start"], r["p_end"]), ("g", r["entity_type"], r["g_start"], r["g_end"])
            if p not in used and g not in used:
                used |= {p, g}
                out.append(r)
        return out

    @F.arrow_udf(f"array<{span}>")
    def run(cases: pa.Array) -> pa.Array:
        return pa.array([greedy(c) for c in cases.to_pylist()], type=kind)

    names = ["entity_type", "p_start", "p_end", "g_start", "g_end", "overlap"]
    cases = pairs.groupBy("case_id").agg(F.collect_list(F.struct(*[F.col(n).cast("string" if n == "entity_type" else "long").alias(n) for n in names])).alias("rows"))
    return cases.select("case_id", F.inline(run("rows")))


def span_scores(pred: DataFrame, gold: DataFrame, matched: DataFrame) -> DataFrame:
    """Precision, recall, F1, F2 overall, by type and by domain in one pass; gold and pred carry ``domain``."""
    rows = [(pred, 1, 0, 0), (gold, 0, 1, 0), (matched, 0, 0, 1)]
    every = reduce(DataFrame.unionByName, [df.select("entity_type", "domain", F.lit(a).alias("n_pred"), F.lit(b).alias("n_gold"), F.lit(c).alias("tp")) for df, a, b, c in rows])
    return grouped_scores(every)


def grouped_scores(counts: DataFrame) -> DataFrame:
    """counts: entity_type, domain, n_pred, n_gold, tp. Grouping sets (), (entity_type), (domain)."""
    grouped = counts.groupingSets([[], ["entity_type"], ["domain"]], "entity_type", "domain").agg(F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold"), F.sum("tp").alias("tp"), F.grouping_id().alias("gid"))
    tp, fp, fn = F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_gold") - F.col("tp")
    scope = F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "entity").otherwise("domain")
    return grouped.select(scope.alias("scope"), F.coalesce("entity_type", "domain", F.lit("")).alias("key"), "tp", fp.alias("fp"), fn.alias("fn"), *[c.alias(k) for k, c in prf(tp, fp, fn).items()])


def merged_spans(spans: DataFrame, key: str = "case_id") -> DataFrame:
    """Overlapping and touching spans of a case as one: gaps and islands."""
    order = Window.partitionBy(key).orderBy("char_start", "char_end")
    far = F.max("char_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("char_start") <= far, 0).otherwise(1)
    marked = spans.filter("char_end > char_start").withColumn("_new", new).withColumn("island", F.sum("_new").over(order))
    return marked.groupBy(key, "island").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end")).drop("island")


def char_scores(pred: DataFrame, gold: DataFrame, texts: DataFrame) -> DataFrame:
    """Characters right, wrong and missed over all cases, with F2 and the false-positive rate.

    texts: case_id, n_chars. Islands of a case meet by range within the case.
    """
    p, g = merged_spans(pred).alias("p"), merged_spans(gold).alias("g")
    hit = p.join(g, (F.col("p.case_id") == F.col("g.case_id")) & (F.col("p.char_start") < F.col("g.char_end")) & (F.col("g.char_start") < F.col("p.char_end")))
    common = F.least("p.char_end", "g.char_end") - F.greatest("p.char_start", "g.char_start")
    length = F.sum(F.col("char_end") - F.col("char_start"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    one = hit.agg(zero(F.sum(common)).alias("tp")).crossJoin(merged_spans(pred).agg(zero(length).alias("n_pred"))).crossJoin(merged_spans(gold).agg(zero(length).alias("n_gold"))).crossJoin(texts.agg(zero(F.sum("n_chars")).alias("n_chars")))  # one row each
    tp, fp, fn = F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_gold") - F.col("tp")
    return one.select("tp", fp.alias("fp"), fn.alias("fn"), (F.col("n_chars") - F.col("n_gold")).alias("non_pii"), *[c.alias(k) for k, c in prf(tp, fp, fn).items()], F.round(ratio(fp, F.col("n_chars") - F.col("n_gold")), 6).alias("fpr"))


def value_scores(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores of values as multisets: of equal values of a case, the lesser count is right."""
    count = lambda df, name: df.groupBy("case_id", "entity_type", "value").agg(F.count(F.lit(1)).alias(name))
    both = count(pred, "a").join(count(gold, "b"), ["case_id", "entity_type", "value"], "full").fillna(0, ["a", "b"])
    out = both.groupBy("entity_type").agg(F.sum(F.least("a", "b")).alias("tp"), F.sum("a").alias("n_pred"), F.sum("b").alias("n_gold"))
    tp, fp, fn = F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_gold") - F.col("tp")
    return out.select("entity_type", "tp", fp.alias("fp"), fn.alias("fn"), *[c.alias(k) for k, c in prf(tp, fp, fn).items()])


def unique_scores(pred: DataFrame, gold: DataFrame, controls: DataFrame) -> DataFrame:
    """Distinct (type, value) keys right, wrong and missed, and how many negative controls were detected."""
    keys = lambda df: df.select("entity_type", "value").distinct()
    p, g, c = keys(pred), keys(gold), keys(controls)
    one = p.intersect(g).agg(F.count(F.lit(1)).alias("tp")).crossJoin(p.subtract(g).agg(F.count(F.lit(1)).alias("fp"))).crossJoin(g.subtract(p).agg(F.count(F.lit(1)).alias("fn"))).crossJoin(p.intersect(c).agg(F.count(F.lit(1)).alias("controls_hit"))).crossJoin(c.agg(F.count(F.lit(1)).alias("controls")))
    return one.select("tp", "fp", "fn", "controls_hit", F.round(ratio(F.col("controls_hit"), F.col("controls")), 6).alias("control_rate"), *[x.alias(k) for k, x in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def numeric_fidelity(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and spread fidelity of each numeric column, in one pass over each table."""
    stats = lambda df, tag: df.agg(*[f(c).alias(f"{tag}_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    both = stats(before, "b").crossJoin(stats(after, "a"))
    rows = [
        F.struct(F.lit(c).alias("column"), F.greatest(F.lit(0.0), 1 - F.abs(F.col(f"a_m_{c}") - F.col(f"b_m_{c}")) / F.greatest(F.abs(F.col(f"b_m_{c}")), F.col(f"b_s_{c}"), F.lit(1.0))).alias("mean_fidelity"), F.greatest(F.lit(0.0), 1 - F.abs(F.col(f"a_s_{c}") - F.col(f"b_s_{c}")) / F.greatest(F.col(f"b_s_{c}"), F.lit(1.0))).alias("std_fidelity"))
        for c in columns
    ]
    return both.select(F.inline(F.array(*rows))).select("column", F.round("mean_fidelity", 6).alias("mean_fidelity"), F.round("std_fidelity", 6).alias("std_fidelity"))


def pearson(a: str, b: str) -> Column:
    """Correlation; 0 where one side does not vary, null for fewer than three pairs."""
    pairs = F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = F.corr(a, b)
    return F.when(pairs >= 3, F.coalesce(F.when(F.isnan(r), 0.0).otherwise(r), F.lit(0.0)))


def correlation_fidelity(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """1 - half the difference of correlation, for each pair of columns; one pass over each table."""
    pairs = [(x, y) for k, x in enumerate(columns) for y in columns[k + 1 :]]
    one = lambda df, tag: df.agg(*[pearson(x, y).alias(f"{tag}_{x}_{y}") for x, y in pairs])
    both = one(before, "b").crossJoin(one(after, "a"))
    rows = [F.struct(F.lit(x).alias("left_column"), F.lit(y).alias("right_column"), F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col(f"b_{x}_{y}") - F.col(f"a_{x}_{y}")) / 2), 6).alias("fidelity")) for x, y in pairs]
    return both.select(F.inline(F.array(*rows)))


def categorical_fidelity(before: DataFrame, after: DataFrame, col: str) -> DataFrame:
    """label_fidelity and shape_fidelity: 1 - total variation by label, and by rank of frequency."""
    share = lambda df: df.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))  # noqa: E731  one row a category
    a, b = share(before), share(after)
    tv = lambda key: a.select(key, F.col("p").alias("pa")).join(b.select(key, F.col("p").alias("pb")), key, "full").agg((0.5 * F.sum(F.abs(F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0))))).alias("tv"))
    return tv("label").select(F.round(1 - F.col("tv"), 6).alias("label_fidelity")).crossJoin(tv("rank").select(F.round(1 - F.col("tv"), 6).alias("shape_fidelity")))


def is_categorical(df: DataFrame, col: str) -> DataFrame:
    n, d = F.count(col), F.count_distinct(col)
    return df.agg(n.alias("n"), d.alias("distinct"), F.round(d / n, 6).alias("unique_ratio"), ((d <= 32) & (d / n <= 0.5)).alias("categorical"))


#: Distinct pairs of values that one task of ``order_concordance`` orders, about; and the most blocks, whose squared number the driver holds.
CELLS, MOST_BLOCKS = 250_000, 2_000


def inversions(first: tuple[np.ndarray, ...], second: tuple[np.ndarray, ...], weight: np.ndarray) -> int:
    """Weight of the pairs that ``first`` and ``second`` (keys, the leading one first) order differently; no two rows have equal keys.

    Rows stand in the first order and are dealt by the bits of their rank in the second, the highest bit first: at
    each bit, those with 1 that stand before one with 0 of the same higher bits are inverted.
    """
    n = len(weight)
    rank = np.empty(n, dtype=np.int64)
    rank[np.lexsort(second[::-1])] = np.arange(n)
    order = np.lexsort(first[::-1])
    rank, weight, total = rank[order], weight[order], 0
    for bit in range(n.bit_length() - 1, -1, -1):
        ones = np.concatenate([[0], np.cumsum(weight * (rank >> bit & 1))])
        high = rank >> bit + 1
        start = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if n else np.zeros(0, dtype=np.int64)
        base = np.repeat(ones[start], np.diff(np.append(start, n)))
        total += int((weight * (1 - (rank >> bit & 1)) * (ones[:-1] - base)).sum())
        order = np.argsort(rank >> bit, kind="stable")
        rank, weight = rank[order], weight[order]
    return total


def block_of(first: str, second: str, splits: list[tuple]) -> Column:
    """How many of the ascending ``splits`` (pairs) are not above the row's pair."""
    lead = np.array([s[0] for s in splits])
    then = np.array([s[1] for s in splits])

    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        a, b = x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(lead, a, "left"), np.searchsorted(lead, a, "right")
        out = low.copy()
        for k in np.unique(low[low < high]).tolist():
            mine = (low == k) & (low < high)
            out[mine] += np.searchsorted(then[k : high[mine][0]], b[mine], "right")
        return pa.array(out.astype(np.int32))

    return run(F.col(first), F.col(second))


def discordant(cells: DataFrame, per_block: int = CELLS) -> int:
    """Weight of the pairs of cells (before, after, weight; distinct) of which one is above in ``before`` and below in ``after``.

    Cells lie in blocks of both orders, (before, after) and (after, before); equal values are ordered alike in both,
    so they count for nothing. Pairs of one block are counted by one task, in the second order only those not in one
    block of the first; all other pairs follow from the weight in each pair of blocks.
    """
    n = cells.count()
    blocks = max(1, min(MOST_BLOCKS, -(-n // per_block)))
    some = cells.filter(F.pmod(F.xxhash64("before", "after"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, blocks * 100 / max(1, n))))).select("before", "after").collect() if blocks > 1 else []

    def splits(first: int) -> list[tuple]:
        at = sorted((r[first], r[1 - first]) for r in some)
        return sorted({at[len(at) * k // blocks] for k in range(1, blocks)}) if at else []

    by_before, by_after = splits(0), splits(1)
    zero = F.lit(0)
    placed = cells.withColumn("i", block_of("before", "after", by_before) if by_before else zero).withColumn("j", block_of("after", "before", by_after) if by_after else zero)

    def one_task(second: bool):
        def run(t: pa.Table) -> pa.Table:
            x, y, w, i = (t.column(k).to_numpy() for k in ("before", "after", "weight", "i"))
            n = inversions((i, y, x) if second else (x, y), (y, x), w) if len(w) else 0
            return pa.table({"n": pa.array([n], type=pa.int64())})

        return run

    total = placed.groupBy("i").applyInArrow(one_task(False), "n bigint").agg(F.sum("n")).first()[0] or 0
    if blocks > 1:
        total += placed.groupBy("j").applyInArrow(one_task(True), "n bigint").agg(F.sum("n")).first()[0] or 0
        held = np.zeros((len(by_before) + 1, len(by_after) + 1), dtype=np.int64)
        for r in placed.groupBy("i", "j").agg(F.sum("weight").alias("w")).toLocalIterator():
            held[r["i"], r["j"]] = r["w"]
        above = np.zeros_like(held)
        above[1:, :-1] = held.cumsum(axis=0)[:-1, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]  # before in the first order, after in the second
        total += int((held * above).sum())
    return int(total)


def order_concordance(pairs: DataFrame, per_block: int = CELLS) -> DataFrame:
    """Share of pairs of rows whose two dates order alike (both equal counts as alike), over all pairs at every size.

    pairs: id, before, after (numbers). Rows of different ids make a pair; a pair with a null date is not alike. Alike
    are all pairs but the discordant ones and those equal in one date only, so nothing is joined.
    """
    kinds = dict(pairs.dtypes)
    number = lambda c: F.col(c).cast("long" if kinds[c] in ("tinyint", "smallint", "int", "bigint") else "double").alias(c)
    rows = pairs.filter("id is not null").select("id", number("before"), number("after"))
    dated = rows.filter("before is not null and after is not null")

    def equal(df: DataFrame, *by: str) -> int:
        """Pairs of rows that are equal in all of ``by``."""
        n = F.col("count").cast("decimal(38,0)")
        return int(df.groupBy(*by).count().agg(F.sum(n * (n - 1))).first()[0] or 0) // 2

    cells = dated.groupBy("before", "after").agg(F.count(F.lit(1)).alias("weight"))
    n = dated.count()
    alike = n * (n - 1) // 2 - discordant(cells, per_block) - equal(dated, "before") - equal(dated, "after") + 2 * equal(dated, "before", "after")
    n = rows.count()
    every = n * (n - 1) // 2
    same = equal(rows, "id")
    if same:  # rows of one id make no pair
        def alike_in_one(t: pa.Table) -> pa.Table:
            x, y = (t.column(k).to_numpy() for k in ("before", "after"))
            (keys, w), own = np.unique(np.rec.fromarrays([x, y]), return_counts=True), lambda v: int(sum(c * (c - 1) for c in np.unique(v, return_counts=True)[1].tolist())) // 2
            both = int((w * (w - 1)).sum()) // 2
            return pa.table({"n": pa.array([len(x) * (len(x) - 1) // 2 - inversions((keys.f0, keys.f1), (keys.f1, keys.f0), w) - own(x) - own(y) + 2 * both], type=pa.int64())})

        again = dated.join(dated.groupBy("id").count().filter("count > 1").select("id"), "id")
        alike -= again.groupBy("id").applyInArrow(alike_in_one, "n bigint").agg(F.sum("n")).first()[0] or 0
    every -= same
    return pairs.sparkSession.range(1).select(F.lit(every).cast("long").alias("pairs"), F.round(F.lit(alike / every if every else 0.0), 6).alias("fidelity"), F.lit(True).alias("exact"))


def utility_report(parts: dict[str, float | bool], copies: int, rows: int, reused: int, sensitive: int) -> dict[str, int]:
    """Utility and privacy scores from the single fidelities. The weights."""
    weights = {"schema": 0.18, "mean": 0.17, "std": 0.13, "correlation": 0.22, "category": 0.15, "time": 0.15}
    utility = int(100 * sum(w * float(parts.get(k, 1.0)) for k, w in weights.items()))
    privacy = round(100 * max(0.0, 1 - 0.70 * copies / max(1, rows) - 0.30 * min(1.0, reused / max(1, sensitive))))
    return {"utility": max(0, min(100, utility)), "privacy": max(0, min(100, privacy))}


# Labels of public corpora and the types they stand for.
CORPUS_LABELS = {
    "PERSON_NAME": "FIRSTNAME LASTNAME GIVENNAME SURNAME FULLNAME NAME", "EMAIL": "EMAIL EMAILADDRESS", "PHONE": "PHONE PHONENUMBER TELEPHONENUMBER MOBILE",
    "DATE_OF_BIRTH": "DATEOFBIRTH DOB", "AGE": "AGE", "STREET_ADDRESS": "STREET STREETADDRESS ADDRESS", "LOCALITY": "CITY COUNTY DISTRICT",
    "POSTCODE": "POSTCODE ZIPCODE ZIP PINCODE", "EMPLOYER": "EMPLOYER COMPANY ORGANIZATION ORGANISATION", "JOB_TITLE": "JOBTITLE OCCUPATION",
    "AADHAAR_LIKE": "AADHAAR", "PAN_LIKE": "PAN", "PERSON_TITLE": "TITLE", "GENERIC_DATE": "DATE", "BUILDING_NUMBER": "BUILDINGNUM", "NATIONAL_ID": "IDCARDNUM NATIONALID",
    "PASSPORT_NUMBER": "PASSPORTNUM PASSPORTNUMBER", "DRIVER_LICENSE_NUMBER": "DRIVERLICENSENUM DRIVERLICENSENUMBER", "TAX_IDENTIFIER": "TAXNUM TAXID",
    "SOCIAL_IDENTIFIER": "SOCIALNUM SSN", "PAYMENT_CARD_NUMBER": "CREDITCARDNUMBER CARDNUMBER", "DEMOGRAPHIC_ATTRIBUTE": "GENDER SEX",
}


def corpus_type(label: Column) -> Column:
    """Entity type of a corpus label: prefix of tagging schemes, running number and marks left out; null if unknown."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(F.trim(label)), r"^[BIO]-", ""), r"_[0-9]+$", ""), r"[^A-Z]", "")
    table = {w: t for t, words in CORPUS_LABELS.items() for w in words.split()}
    return V.lookup(clean, table, F.lit(None).cast("string"))


def label_accounting(labels: DataFrame) -> DataFrame:
    """How often each corpus label occurs, and what it maps to."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("entity_type", corpus_type(F.col("label")))


def negative_slots(hits: DataFrame, document: str, tag: str, gold: Column) -> DataFrame:
    """tag, negative_slots, false_hits: slots of a document and a tag without gold, and how many of them a prediction fills.

    ``hits`` has a row for each prediction; ``gold`` tells the right ones. Every document has a slot for every tag; the
    tags, one row each, are the small side.
    """
    slots = hits.select(document).distinct().crossJoin(F.broadcast(hits.select(tag).distinct()))
    have = hits.groupBy(document, tag).agg(F.count_if(gold).alias("g"), F.count(F.lit(1)).alias("p"))
    full = slots.join(have, [document, tag], "left").fillna(0, ["g", "p"])
    return full.groupBy(F.col(tag).alias("tag")).agg(F.count_if(F.col("g") == 0).alias("negative_slots"), F.count_if((F.col("g") == 0) & (F.col("p") > 0)).alias("false_hits"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, p50, p95 (interpolated) and p95_rank (a value that occurs), exact."""
    ranked = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(by).agg(F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"), F.round(ranked, 6).alias("p95_rank"))


def route_counts(requests: DataFrame, top: int = 20) -> DataFrame:
    """route, status, n: the ``top`` most frequent pairs; the report is of these only."""
    return requests.groupBy("route", "status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "route", "status").limit(top)


def unit_breakdown(units: DataFrame) -> DataFrame:
    """source, kind, n, chars, empty: how many units of each kind a source's documents were read into (units: source, kind, text)."""
    text = F.coalesce("text", F.lit(""))
    return units.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars"), F.count_if(F.trim(text) == "").alias("empty"))


def macro_f1(scores: DataFrame, counted: str = "entity") -> DataFrame:
    """macro_f1 and types: the plain mean of F1 over the rows of one scope of ``grouped_scores``."""
    return scores.filter(F.col("scope") == counted).agg(F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 6).alias("macro_f1"), F.count(F.lit(1)).alias("types"))


def relaxed_pairs(pred: DataFrame, gold: DataFrame, compatible: list[tuple[str, str]] = (), least: float = 0.5) -> DataFrame:
    """Predictions and gold of one case that match when relaxed: the type equal or ``compatible`` (predicted, gold), and
    half of either span shared, or one normalized value contained in the other. Rows: case_id, char_start, char_end,
    entity_type, value."""
    p, g = pred.alias("p"), gold.alias("g")
    kind = F.col("p.entity_type") == F.col("g.entity_type")
    for a, b in compatible:
        kind = kind | (F.col("p.entity_type") == a) & (F.col("g.entity_type") == b)
    common = F.greatest(F.lit(0), F.least("p.char_end", "g.char_end") - F.greatest("p.char_start", "g.char_start"))
    shorter = F.least(F.col("p.char_end") - F.col("p.char_start"), F.col("g.char_end") - F.col("g.char_start"))
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"[^a-z0-9]+", " "))
    inside = (F.length(norm("p.value")) > 0) & (F.length(norm("g.value")) > 0) & (norm("p.value").contains(norm("g.value")) | norm("g.value").contains(norm("p.value")))
    return p.join(g, (F.col("p.case_id") == F.col("g.case_id")) & kind & ((common >= least * F.greatest(F.lit(1), shorter)) | inside)).select("p.case_id", F.col("p.entity_type").alias("entity_type"), F.col("p.char_start").alias("p_start"), F.col("p.char_end").alias("p_end"), F.col("g.entity_type").alias("g_type"), F.col("g.char_start").alias("g_start"), F.col("g.char_end").alias("g_end"), common.cast("long").alias("overlap"))


def relaxed_coverage(pred: DataFrame, gold: DataFrame, compatible: list[tuple[str, str]] = ()) -> DataFrame:
    """tp_pred, n_pred, tp_gold, n_gold, precision, recall, f1: predictions with some relaxed partner, gold with one; not one-to-one."""
    pairs = relaxed_pairs(pred, gold, compatible)
    hit_p = pairs.select("case_id", "entity_type", "p_start", "p_end").distinct().agg(F.count(F.lit(1)).alias("tp_pred"))
    hit_g = pairs.select("case_id", "g_type", "g_start", "g_end").distinct().agg(F.count(F.lit(1)).alias("tp_gold"))
    one = hit_p.crossJoin(hit_g).crossJoin(pred.agg(F.count(F.lit(1)).alias("n_pred"))).crossJoin(gold.agg(F.count(F.lit(1)).alias("n_gold")))  # one row each
    p, r = ratio(F.col("tp_pred"), F.col("n_pred")), ratio(F.col("tp_gold"), F.col("n_gold"))
    return one.select("tp_pred", "n_pred", "tp_gold", "n_gold", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def annotator_scores(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Micro scores over annotators, recall of direct and quasi identifiers, and how often a value that needs no mask was hit.

    pred: case_id, value. gold: case_id, annotator, value, need (DIRECT, QUASI or NO_MASK). Each annotator's values are
    compared as multisets with the case's predictions; values that need no mask count for the last rate alone. As in the
    query's SQL, a recall without a gold value of its kind is null, and the last rate without a value is not a number.
    """
    keys = ["case_id", "value"]
    seen = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"))
    masked = gold.filter("need <> 'NO_MASK'")
    wanted = masked.groupBy("annotator", *keys).agg(F.count(F.lit(1)).alias("b"), F.count_if(F.col("need") == "DIRECT").alias("direct"))
    both = wanted.join(seen, keys, "left").withColumn("tp", F.least("b", F.coalesce("a", F.lit(0))))
    cases = gold.select("annotator", "case_id").distinct()
    n_pred = cases.join(seen, "case_id").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n_pred"))
    direct = F.col("direct") > 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = both.agg(total("tp").alias("tp"), total("b").alias("n_gold"), total(F.when(direct, F.col("tp"))).alias("tp_d"), total(F.when(direct, F.col("b"))).alias("n_d"), total(F.when(~direct, F.col("tp"))).alias("tp_q"), total(F.when(~direct, F.col("b"))).alias("n_q"))
    none = gold.filter("need = 'NO_MASK'").select("annotator", *keys).distinct().join(seen, keys, "left").agg(F.count(F.lit(1)).alias("n_free"), F.count("a").alias("hit_free"))
    one = sums.crossJoin(n_pred).crossJoin(none)  # one row each
    recall = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    free = F.when(F.col("n_free") > 0, F.round(F.col("hit_free") / F.col("n_free"), 6)).otherwise(float("nan"))
    tp, fp, fn = F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_gold") - F.col("tp")
    return one.select("tp", fp.alias("fp"), fn.alias("fn"), *[c.alias(k) for k, c in prf(tp, fp, fn).items()], recall("tp_d", "n_d").alias("direct_recall"), recall("tp_q", "n_q").alias("quasi_recall"), free.alias("no_mask_rate"))


def assign(pairs: DataFrame, left: str, right: str, score: str, scope: str) -> DataFrame:
    """One-to-one pairs of each scope by falling score (then left, then right): each side is used once. A scope's pairs make one row."""
    kinds = pairs.schema
    item = f"struct<{left}:{kinds[left].dataType.simpleString()},{right}:{kinds[right].dataType.simpleString()},{score}:double>"

    @F.arrow_udf(f"array<{item}>")
    def run(scopes: pa.Array) -> pa.Array:
        out = []
        for rows in scopes.to_pylist():
            used_l, used_r, kept = set(), set(), []
            for r in sorted(rows, key=lambda r: (-r[score], r[left], r[right])):
                if r[left] not in used_l and r[right] not in used_r:
                    used_l.add(r[left])
                    used_r.add(r[right])
                    kept.append(r)
            out.append(kept)
        return pa.array(out, type=scopes.type)

    grouped = pairs.groupBy(scope).agg(F.collect_list(F.struct(left, right, F.col(score).cast("double").alias(score))).alias("rows"))
    return grouped.select(scope, F.inline(run("rows")))


def within_reach(places: DataFrame, scope: str, key: str, place: str, reach: float) -> DataFrame:
    """(a, b): pairs of keys of one scope, the lesser first, whose places differ by less than ``reach``.

    Places lie in bins of ``reach``; a place meets those of its bin and the next, so the join is by equal keys.
    """
    bin_ = F.floor(F.col(place) / reach).cast("long")
    own = places.select(F.col(scope).alias("s"), F.col(key).alias("k"), F.col(place).alias("x"), bin_.alias("bin"))
    left, right = own, own.withColumn("bin", F.explode(F.array(F.col("bin"), F.col("bin") - 1))).toDF("s", "k2", "x2", "bin")
    # a pair of one bin meets once; a pair of neighbouring bins meets in the lower one
    same = F.floor(F.col("x") / reach) == F.floor(F.col("x2") / reach)
    met = left.join(right, ["s", "bin"]).filter((F.abs(F.col("x") - F.col("x2")) < reach) & (~same & (F.col("k") != F.col("k2")) | same & (F.col("k") < F.col("k2"))))
    return met.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"))
