"""Registry of queries with their DuckDB SQL, the fixtures they derive from the driver's tables, and SQL shared by oracles."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions import taxonomy as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it lies; a cluster gets it by --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- fixtures: the same SQL in both engines -------------------------------------------------------------

_KINDS = "EMAIL PHONE AADHAAR_LIKE PAN_LIKE PERSON_NAME DATE_OF_BIRTH AGE STREET_ADDRESS LOCALITY POSTCODE EMPLOYER JOB_TITLE CASE_REFERENCE PASSPORT_NUMBER PAYMENT_CARD_NUMBER BUILDING_NUMBER PERSON_TITLE GENERIC_DATE DEMOGRAPHIC_ATTRIBUTE TAX_IDENTIFIER".split()
_K = "cast(c_custkey as string)"
_DATE = "concat(lpad(cast(1 + c_custkey % 28 as string), 2, '0'), '/', lpad(cast(1 + c_custkey % 12 as string), 2, '0'), '/', cast(1940 + c_custkey % 80 as string))"
#: Identity values of each customer: doc_id, entity_type, plaintext.
VALUES = f"""
SELECT c_custkey AS doc_id, t.entity_type AS entity_type, CASE t.entity_type
  WHEN 'EMAIL' THEN concat('Cust', {_K}, ' @Mail.Example.ORG')
  WHEN 'PHONE' THEN concat('+91 98', lpad({_K}, 8, '0'))
  WHEN 'AADHAAR_LIKE' THEN concat(lpad(cast(c_custkey % 9000 + 1000 as string), 4, '0'), ' 5678 ', lpad(cast(c_custkey % 7919 as string), 4, '0'))
  WHEN 'PAN_LIKE' THEN concat('abcde ', lpad(cast(c_custkey % 10000 as string), 4, '0'), ' f')
  WHEN 'PERSON_NAME' THEN concat(' ', replace(c_name, '#', '  '), ' ')
  WHEN 'DATE_OF_BIRTH' THEN {_DATE}
  WHEN 'AGE' THEN concat(cast(c_custkey % 121 as string), ' years')
  WHEN 'STREET_ADDRESS' THEN concat({_K}, ' Mill Road, Town ', cast(c_custkey % 50 as string))
  WHEN 'LOCALITY' THEN CASE c_custkey % 5 WHEN 0 THEN 'Navi Mumbai' WHEN 1 THEN 'Bangalore' WHEN 2 THEN 'New Delhi' WHEN 3 THEN concat('Ward ', {_K}, ', Leeds') ELSE 'Mysuru' END
  WHEN 'POSTCODE' THEN lpad(cast(c_custkey % 1000000 as string), 6, '5')
  WHEN 'EMPLOYER' THEN concat(c_mktsegment, CASE c_custkey % 5 WHEN 0 THEN ' Software' WHEN 1 THEN ' Clinic' WHEN 2 THEN ' College' WHEN 3 THEN ' Ministry' ELSE ' Traders' END)
  WHEN 'JOB_TITLE' THEN CASE c_custkey % 5 WHEN 0 THEN 'Junior Clerk' WHEN 1 THEN 'Data Analyst' WHEN 2 THEN 'Civil Engineer' WHEN 3 THEN 'Sales Manager' ELSE 'Cook' END
  WHEN 'CASE_REFERENCE' THEN concat('Case-', {_K}, '/A')
  WHEN 'PASSPORT_NUMBER' THEN concat('x-', lpad({_K}, 7, '1'))
  WHEN 'PAYMENT_CARD_NUMBER' THEN concat('4111 1111 1111 ', lpad(cast(c_custkey % 10000 as string), 4, '0'))
  WHEN 'BUILDING_NUMBER' THEN concat({_K}, 'A')
  WHEN 'PERSON_TITLE' THEN 'Dr.'
  WHEN 'GENERIC_DATE' THEN concat('in ', cast(1990 + c_custkey % 30 as string))
  WHEN 'TAX_IDENTIFIER' THEN concat('t', cast(c_custkey % 3 as string))
  ELSE 'Female' END AS plaintext
FROM {{customer}} CROSS JOIN (VALUES {", ".join(f"('{k}')" for k in _KINDS)}) AS t(entity_type)
"""
#: Mentions in documents: a value for each customer and some types, repeated, with places and review states.
MENTIONS = """
SELECT c_custkey % 97 AS doc_id, t.entity_type AS entity_type,
  CASE t.entity_type WHEN 'PERSON_NAME' THEN concat('Person ', cast(c_custkey % 13 as string)) WHEN 'EMAIL' THEN concat('p', cast(c_custkey % 13 as string), '@example.org')
    WHEN 'PHONE' THEN concat('+91 9800000', lpad(cast(c_custkey % 17 as string), 3, '0')) WHEN 'LOCALITY' THEN concat('Town ', cast(c_nationkey as string)) WHEN 'AGE' THEN cast(20 + c_custkey % 40 as string)
    WHEN 'JOB_TITLE' THEN 'Analyst' ELSE concat('CASE-', cast(c_custkey % 31 as string)) END AS plaintext,
  cast(c_custkey * 64 + t.k * 8 as bigint) AS char_start, cast(c_custkey * 64 + t.k * 8 + 6 as bigint) AS char_end, cast(0.9 + t.k / 100.0 as double) AS confidence,
  CASE WHEN t.entity_type <> 'PERSON_NAME' THEN 'NOT_REQUIRED' WHEN c_custkey % 11 = 0 THEN 'IGNORE' WHEN c_custkey % 7 = 0 THEN 'PROTECT' WHEN c_custkey % 5 = 0 THEN 'PENDING' ELSE 'NOT_REQUIRED' END AS review_status,
  CASE WHEN t.entity_type = 'PERSON_NAME' AND c_custkey % 13 = 4 THEN 'mother''s name' WHEN t.entity_type = 'PERSON_NAME' AND c_custkey % 13 = 6 THEN 'Witness name' ELSE 'name' END AS context_label
FROM {customer} CROSS JOIN (VALUES ('PERSON_NAME', 0), ('EMAIL', 1), ('PHONE', 2), ('LOCALITY', 3), ('AGE', 4), ('JOB_TITLE', 5), ('CASE_REFERENCE', 6)) AS t(entity_type, k)
WHERE (c_custkey + t.k) % 3 <> 0
"""
#: Gold and predicted spans of cases made from order lines.
GOLD = """SELECT l_orderkey AS case_id, CASE l_linenumber % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PHONE' ELSE 'PERSON_NAME' END AS entity_type, l_returnflag AS domain,
  cast(l_linenumber * 40 + l_partkey % 10 as bigint) AS char_start, cast(l_linenumber * 40 + l_partkey % 10 + 8 + l_suppkey % 12 as bigint) AS char_end FROM {lineitem} WHERE l_quantity < 30"""
PRED = """SELECT l_orderkey AS case_id, CASE (l_linenumber + CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END) % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PHONE' ELSE 'PERSON_NAME' END AS entity_type, l_returnflag AS domain,
  cast(l_linenumber * 40 + l_partkey % 10 + l_suppkey % 4 as bigint) AS char_start, cast(l_linenumber * 40 + l_partkey % 10 + 8 + l_suppkey % 9 as bigint) AS char_end FROM {lineitem} WHERE l_quantity > 10"""
#: A ledger of events for each user, and a few that were tampered with.
LEDGER_EVENTS = """SELECT cast(user_id as string) AS job_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) as bigint) AS sequence, event_type, cast(event_id as string) AS timestamp, concat('d', cast(event_id % 7 as string)) AS details FROM {events}"""


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture's rows in Spark."""
    names = [n for n in ("customer", "lineitem", "events", "documents", "orders", "nation", "part", "supplier") if f"{{{n}}}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def duck(sql: str) -> str:
    """A fixture's SQL for DuckDB."""
    for n in ("customer", "lineitem", "events", "documents", "orders", "nation", "part", "supplier"):
        sql = sql.replace(f"{{{n}}}", n)
    return sql.strip()


# --- scalar rules in DuckDB SQL --------------------------------------------------------------------------


def names(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def d_normalize(t: str, v: str) -> str:
    space = f"regexp_replace({v}, '\\s+', '', 'g')"
    return f"""CASE WHEN {t} = 'EMAIL' THEN lower({space}) WHEN {t} = 'PAN_LIKE' THEN upper({space})
  WHEN {t} IN ({names(T.TEXTUAL)}) THEN lower(trim(regexp_replace({v}, '\\s+', ' ', 'g')))
  WHEN {t} IN ({names(T.ALPHANUMERIC)}) THEN regexp_replace(upper({v}), '[^A-Z0-9]', '', 'g')
  ELSE regexp_replace({v}, '[^0-9]', '', 'g') END"""


def d_mask(t: str, v: str) -> str:
    n = f"({d_normalize(t, v)})"
    return f"""CASE {t} WHEN 'PHONE' THEN repeat('X', greatest(0, length({n}) - 4)) || right({n}, 4) WHEN 'AADHAAR_LIKE' THEN 'XXXX XXXX ' || right({n}, 4)
  WHEN 'PAN_LIKE' THEN 'XXXXXX' || right({n}, 4) WHEN 'EMAIL' THEN coalesce(nullif(left(split_part({n}, '@', 1), 1), ''), 'x') || '***@' || split_part({n}, '@', 2)
  WHEN 'PERSON_NAME' THEN '[NAME PROTECTED]' WHEN 'CASE_REFERENCE' THEN '[REFERENCE PROTECTED]' WHEN 'PAYMENT_CARD_NUMBER' THEN 'XXXX XXXX XXXX ' || coalesce(nullif(right({n}, 4), ''), 'XXXX')
  ELSE CASE WHEN {t} IN ({names(T.ALPHANUMERIC)}) THEN CASE WHEN {n} = '' THEN '[CREDENTIAL MASKED]' ELSE '[CREDENTIAL MASKED ' || right({n}, 4) || ']' END ELSE '[PROTECTED]' END END"""


def d_year(v: str) -> str:
    fmts = ["%d %B %Y", "%d %b %Y", "%B %d %Y", "%b %d %Y", "%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%d.%m.%Y"]
    tries = ", ".join(f"year(try_strptime(trim(replace({v}, ',', '')), '{f}'))" for f in fmts)
    return f"coalesce({tries}, try_cast(nullif(regexp_extract({v}, '\\b((?:19|20)[0-9]{{2}})\\b', 1), '') AS BIGINT))"


def d_case(v: str, families, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({v}), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for words, name in families) + f" ELSE '{rest}' END"


def d_age(v: str) -> str:
    n = f"try_cast(nullif(regexp_extract({v}, '[0-9]{{1,3}}'), '') AS INTEGER)"
    return f"CASE WHEN {n} IS NULL THEN 'Age band protected' " + " ".join(f"WHEN {n} BETWEEN {a} AND {b} THEN 'Age {a}-{b}'" for a, b in ((0, 12), (13, 17), (18, 24), (25, 34), (35, 44), (45, 54), (55, 64))) + " ELSE 'Age 65+' END"


def d_place(v: str) -> str:
    return f"""CASE WHEN contains(lower({v}), 'bengaluru') OR contains(lower({v}), 'bangalore') THEN 'Bengaluru metropolitan area' WHEN contains(lower({v}), 'mumbai') THEN 'Mumbai metropolitan area'
  WHEN contains(lower({v}), 'delhi') THEN 'Delhi metropolitan area' WHEN regexp_matches(lower({v}), '\\b(street|st|avenue|ave|road|rd|lane|ln|boulevard|blvd|drive|dr|way|court|ct)\\b') THEN 'Urban street area'
  WHEN len(list_filter(string_split({v}, ','), lambda p: trim(p) <> '')) >= 2 THEN 'Regional urban area' ELSE 'City-level location' END"""


def d_generalize(t: str, v: str) -> str:
    from ..functions.values import EMPLOYERS, JOBS

    y, digits = d_year(v), f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return f"""CASE {t} WHEN 'DATE_OF_BIRTH' THEN coalesce('Born ' || CAST({y} - {y} % 5 AS VARCHAR) || '-' || CAST({y} - {y} % 5 + 4 AS VARCHAR), 'Birth year band protected')
  WHEN 'AGE' THEN {d_age(v)} WHEN 'STREET_ADDRESS' THEN {d_place(v)} WHEN 'LOCALITY' THEN {d_place(v)}
  WHEN 'POSTCODE' THEN CASE WHEN length({digits}) >= 3 THEN left({digits}, 3) || 'XXX' ELSE 'Regional postcode' END
  WHEN 'EMPLOYER' THEN {d_case(v, EMPLOYERS, "Private-sector organisation")} WHEN 'JOB_TITLE' THEN {d_case(v, JOBS, "Professional role")}
  WHEN 'PERSON_TITLE' THEN 'Personal title protected' WHEN 'GENERIC_DATE' THEN coalesce('Date in ' || CAST({y} AS VARCHAR), 'Date generalized') WHEN 'BUILDING_NUMBER' THEN 'Building number generalized'
  WHEN 'DEMOGRAPHIC_ATTRIBUTE' THEN 'Demographic category protected' WHEN 'CASE_REFERENCE' THEN '[REFERENCE PROTECTED]' ELSE '[GENERALIZED]' END"""


def d_letter(i: str) -> str:
    return f"(chr(CAST(65 + {i} % 26 AS INTEGER)) || CASE WHEN {i} < 26 THEN '' ELSE CAST({i} // 26 + 1 AS VARCHAR) END)"


def d_map(t: str, table_: dict[str, str], rest: str) -> str:
    return f"CASE {t} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {rest} END"


def d_replacement(t: str, v: str, a: str, i: str) -> str:
    return f"""CASE {a} WHEN 'RETAIN' THEN {v} WHEN 'REMOVE' THEN {d_map(t, T.REMOVED_TEXT, "'[PROTECTED]'")}
  WHEN 'PROTECT' THEN '[' || {d_map(t, T.TOKEN_PREFIX, t)} || '_' || lpad(CAST({i} + 1 AS VARCHAR), CAST(greatest(3, length(CAST({i} + 1 AS VARCHAR))) AS INTEGER), '0') || ']'
  WHEN 'MASK' THEN CASE WHEN {t} IN ({names(T.QUASI)}) THEN '[CONTEXT PROTECTED]' ELSE {d_mask(t, v)} END
  WHEN 'SYNTHESIZE' THEN '[SYNTHETIC TWIN VALUE]' WHEN 'PSEUDONYMIZE' THEN {d_map(t, T.ALIAS_PREFIX, "'Pseudonym'")} || ' ' || {d_letter(i)}
  ELSE {d_generalize(t, v)} END"""


def policy_values() -> str:
    """The policy as a derived table p(entity_type, level, audience, action, residual, loss, weight)."""
    rows = ", ".join(f"('{t}', {level}, '{aud}', '{a}', {res}::DOUBLE, {loss}, {w})" for t, _, level, aud, a, res, loss, w in T.policy_rows())
    return f"(VALUES {rows}) AS p(entity_type, level, audience, action, residual, loss, weight)"


def d_band(s: str) -> str:
    return f"CASE WHEN {s} >= 75 THEN 'critical' WHEN {s} >= 50 THEN 'high' WHEN {s} >= 25 THEN 'moderate' ELSE 'low' END"


def d_related(c: str) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{w}')" for w in T.RELATION_WORDS) + ")"


LINES_SQL = """SELECT doc_id, line_no, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
D_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN (2 * CAST(substr(d, i, 1) AS INTEGER)) // 10 + (2 * CAST(substr(d, i, 1) AS INTEGER)) % 10 ELSE CAST(substr(d, i, 1) AS INTEGER) END)) % 10 = 0"
