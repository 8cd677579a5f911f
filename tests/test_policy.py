"""Policy, values, graph and recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushgrid.functions import taxonomy as T
from hushgrid.functions import values as V
from hushgrid.operators import graph as G


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_policy_is_total():
    rows = T.policy_rows()
    assert len(rows) == 390 and len({r[:1] + r[2:4] for r in rows}) == 390
    assert T.action("EMPLOYER", 3, "INTERNAL_OPERATIONS") == "RETAIN"
    assert T.action("EMPLOYER", 4, "PUBLIC_RELEASE") == "PSEUDONYMIZE"
    assert T.action("FACE", 5, "PUBLIC_RELEASE") == "REMOVE"
    assert T.action("DATE_OF_BIRTH", 2, "RESEARCH_PARTNER") == "PROTECT"
    assert all(T.action(t, 1, "PUBLIC_RELEASE") == "MASK" for t in T.DIRECT)


def test_masks(spark):
    cases = {
        ("PHONE", "+91 98765-43210"): "XXXXXXXX3210",
        ("AADHAAR_LIKE", "2345 6789 0123"): "XXXX XXXX 0123",
        ("PAN_LIKE", "abcde 1234 f"): "XXXXXX234F",
        ("EMAIL", "Asha@Example.org"): "a***@example.org",
        ("PERSON_NAME", "x"): "[NAME PROTECTED]",
        ("PAYMENT_CARD_NUMBER", ""): "XXXX XXXX XXXX XXXX",
        ("PASSPORT_NUMBER", "x-12"): "[CREDENTIAL MASKED X12]",
        ("TAX_IDENTIFIER", "-"): "[CREDENTIAL MASKED]",
    }
    for (t, v), want in cases.items():
        assert one(spark, V.mask(F.lit(t), F.lit(v))) == want


def test_generalize(spark):
    cases = {("AGE", "17"): "Age 13-17", ("AGE", "x"): "Age band protected", ("DATE_OF_BIRTH", "3 May 2007"): "Born 2005-2009", ("POSTCODE", "570001"): "570XXX", ("LOCALITY", "Navi Mumbai"): "Mumbai metropolitan area", ("EMPLOYER", "City Hospital"): "Healthcare organisation", ("JOB_TITLE", "Junior data engineer"): "Early-career professional"}
    for (t, v), want in cases.items():
        assert one(spark, V.generalize(F.lit(t), F.lit(v))) == want
    assert [one(spark, V.letter(F.lit(k))) for k in (0, 25, 26, 53)] == ["A", "Z", "A2", "B3"]


def test_luhn_and_presence(spark):
    assert one(spark, V.luhn(F.lit("4111 1111 1111 1111"))) and not one(spark, V.luhn(F.lit("0000000000000")))
    assert one(spark, V.present(F.lit("AGE"), F.lit("34"), F.lit("aged 34.")))
    assert not one(spark, V.present(F.lit("AGE"), F.lit("34"), F.lit("34-36 and 1345")))
    assert not one(spark, V.present(F.lit("EMAIL"), F.lit(""), F.lit("x")))


def test_splice(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("replacement")) for a, b, r in ((0, 2, "X"), (3, 5, ""))])
    assert one(spark, V.splice(F.lit("abcdefg"), spans)) == "Xcfg"


def entities(spark, rows):
    return spark.createDataFrame([(1, f"e{k}", t, f"{t}_001", k, c, 1, "automatic") for k, (t, c) in enumerate(rows)], "doc_id bigint, entity_id string, entity_type string, placeholder string, first_pos bigint, context string, mention_count bigint, review_state string")


def test_risk_and_graph(spark):
    e = entities(spark, [("PERSON_NAME", "name"), ("PERSON_NAME", "mother's name"), ("DATE_OF_BIRTH", ""), ("POSTCODE", ""), ("EMPLOYER", "")])
    r = G.risk(e).filter("level = 1 and audience = 'PUBLIC_RELEASE'").first()
    # by hand: direct round(44*.6)=26, quasi round(46*.55)=25, relation 14, combination round(26*.7)=18
    assert (r.direct_before_part, r.quasi_before_part, r.relation_before_part, r.combo_before_part, r.before, r.band_before) == (26, 25, 14, 18, 83, "critical")
    kinds = {(x.kind) for x in G.nodes(e).collect()}
    assert kinds == {"DOCUMENT", "SUBJECT", "RELATED_PERSON", "QUASI_IDENTIFIER"}
    types = [x.edge_type for x in G.edges(e).collect()]
    assert types.count("CO_OCCURS_WITH") == 2 and types.count("RELATED_TO") == 1
    assert [x.score for x in G.paths(e).orderBy("rank").collect()] == [26, 17, 14]
    assert G.graph_hash(G.nodes(e), G.edges(e)).count() == 1


def test_exposure_falls_with_level(spark):
    e = entities(spark, [("EMAIL", ""), ("PHONE", ""), ("STREET_ADDRESS", ""), ("EMPLOYER", ""), ("AGE", "")])
    after = {r.level: r.after for r in G.risk(e).filter("audience = 'PUBLIC_RELEASE'").collect()}
    assert after[1] >= after[3] >= after[4] >= after[5]


def test_recommendation(spark):
    rows = [("Republic archive", "", "INTERNAL_OPERATIONS", "TEXT", 10, ["AGE"]), ("synthetic set", "", "RESEARCH_PARTNER", "DATASET", 10, ["AGE"]), ("", "", "RESEARCH_PARTNER", "TEXT", 80, ["AGE"]), ("", "", "INTERNAL_OPERATIONS", "TEXT", 80, ["PAN_LIKE"])]
    df = spark.createDataFrame(rows, "purpose string, recipient string, audience string, file_type string, risk_before int, entity_types array<string>")
    assert [r.recommended_level for r in G.recommend(df).collect()] == [4, 5, 4, 2]
