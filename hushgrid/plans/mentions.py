"""Queries of the detectors: every family over lines made from customers, whose values and places SQL knows.

A line is (type, text before, value, text behind); a line without a type holds nothing to find. All mentions of the
families are compared, so a detector that finds too much fails as one that finds too little.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect
from .base import duck, fixture, query

K = "cast(c_custkey as string)"
K4 = "lpad(cast(c_custkey % 9000 + 1000 as string), 4, '0')"
PERSON = "CASE c_custkey % 4 WHEN 0 THEN 'Asha Verma' WHEN 1 THEN 'Tomas Lindqvist' WHEN 2 THEN 'Mary O''Neill' ELSE 'Lena Hoff' END"
PLACE = "CASE c_custkey % 3 WHEN 0 THEN 'Leeds' WHEN 1 THEN 'New Haven' ELSE 'Mysuru' END"
AGE = "cast(18 + c_custkey % 70 as string)"
DAY = "concat(cast(1940 + c_custkey % 60 as string), '-0', cast(1 + c_custkey % 9 as string), '-11')"


def lines_query(name: str, only: tuple[str, ...], lines: list[tuple[str | None, str, str | None, str]], reviews: bool = False) -> None:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts, wanted = [], []
    for k, (kind, before, value, behind) in enumerate(lines):
        if k:
            parts.append("chr(10)")
        parts.append(quoted(before))
        if kind:
            wanted.append(f"SELECT c_custkey AS doc_id, '{kind}' AS entity_type, {value} AS plaintext, CAST(length(concat({', '.join(parts)})) AS BIGINT) AS char_start FROM customer")
        if value:
            parts.append(value)
        parts.append(quoted(behind))
    text = f"SELECT c_custkey AS doc_id, concat({', '.join(parts)}) AS text FROM {{customer}}"

    @query(name, duck(" UNION ALL ".join(wanted)))
    def run(spark, d):
        found = detect.mentions(fixture(spark, d, text), only=only)
        return found.select("doc_id", "entity_type", "plaintext", F.col("char_start").cast("long").alias("char_start"))


lines_query("det_direct", ("direct",), [("EMAIL", "write to ", f"concat('p', {K}, '@mail.example.org')", " today"), ("PAN_LIKE", "PAN ", f"concat('ABCDE', {K4}, 'F')", " issued"), ("AADHAAR_LIKE", "number ", f"concat({K4}, ' 5678 ', {K4})", " on file"), ("PHONE", "Phone: ", f"concat('+91 98', lpad({K}, 8, '0'))", ""), ("PHONE", "software version ", f"concat('2345 6789 ', {K4})", ""), (None, "12345678 pieces", None, "")])
lines_query("det_quasi", ("quasi",), [("DATE_OF_BIRTH", "Date of Birth: ", "concat('12/03/', cast(1930 + c_custkey % 90 as string))", ""), ("AGE", "Age: ", f"concat({AGE}, ' years')", ""), ("STREET_ADDRESS", "Home Address: ", f"concat({K}, ' Mill Road, Mysuru')", ""), ("POSTCODE", "Pincode: ", f"concat('57', {K4})", ""), ("EMPLOYER", "Company - ", f"concat('Firm ', {K})", ""), ("JOB_TITLE", "Designation: ", f"concat('Clerk ', {K})", ""), ("CASE_REFERENCE", "Case Reference: ", f"concat('AB/', {K4}, '-17')", ""), (None, "Date of Birth: 12/03/2190", None, ""), (None, "City: unknown", None, "")])
lines_query("det_names", ("names",), [("PERSON_NAME", "Full Name: ", PERSON, ""), (None, "Patient name: unknown", None, ""), (None, "Guardian's name: 12 Mill Road", None, ""), ("PERSON_NAME", "Witness name - ", PERSON, "")])
lines_query("det_below_label", ("quasi", "names"), [(None, "City:", None, ""), ("LOCALITY", "", PLACE, ""), (None, "Applicant", None, ""), ("PERSON_NAME", "", PERSON, ""), (None, "Pincode:", None, ""), (None, "Employer:", None, ""), (None, "x", None, ""), (None, "-", None, "")])
lines_query("det_dates_ages", ("broad",), [("GENERIC_DATE", "filed on ", DAY, " in court"), ("GENERIC_DATE", "seen ", "concat(cast(1 + c_custkey % 28 as string), ' March 2021')", " at noon"), ("GENERIC_DATE", "then ", "concat('May ', cast(1 + c_custkey % 28 as string), ', 2019')", " it was"), ("AGE", "a clerk aged ", AGE, " told us"), ("AGE", "a ", AGE, "-year-old clerk"), (None, "aged 300 days", None, "")])
lines_query("det_credentials", ("broad",), [("PASSPORT_NUMBER", "the passport we saw yesterday was ", f"concat('X12', {K4})", ""), ("SOCIAL_IDENTIFIER", "ssn ", f"concat('123-45-', {K4})", " was told"), ("TAX_IDENTIFIER", "tax id: ", f"concat('TX', {K4}, '9')", ""), ("DRIVER_LICENSE_NUMBER", "driving licence number ", f"concat('DL-', {K4}, '-77')", ""), ("NATIONAL_ID", "", f"concat('NI', {K4}, '5')", " is the identity card")])
lines_query("det_cards", ("broad",), [("PAYMENT_CARD_NUMBER", "paid with ", "'4111 1111 1111 1111'", " today"), ("PAYMENT_CARD_NUMBER", "the credit card ", f"concat('4111 1111 1111 ', {K4})", " was used"), (None, "seen 4111 1111 1111 1112 today", None, "")])
lines_query("det_addresses", ("broad",), [("STREET_ADDRESS", "We live at the far end of ", "CASE c_custkey % 2 WHEN 0 THEN 'Old Mill Lane' ELSE 'Goethe Strasse' END", ""), (None, "the street was long", None, "")])
lines_query("det_places", ("broad",), [("LOCALITY", "the team is based in ", PLACE, " now"), ("LOCALITY", "birthplace: ", PLACE, ""), (None, "based in the office", None, ""), (None, "born in May", None, "")])
lines_query("det_names_said", ("broad",), [("PERSON_NAME", "the note was signed by ", PERSON, ""), ("PERSON_NAME", "account holder ", PERSON, ", by post"), ("PERSON_NAME", "please notify ", PERSON, " at once"), ("PERSON_NAME", "", PERSON, " said that it was late"), (None, "signed by the office", None, "")])
lines_query("det_demographics", ("broad",), [("DEMOGRAPHIC_ATTRIBUTE", "Gender: ", "CASE c_custkey % 2 WHEN 0 THEN 'female' ELSE 'nonbinary' END", ""), ("DEMOGRAPHIC_ATTRIBUTE", "they identify as ", "'agender'", " today"), ("DEMOGRAPHIC_ATTRIBUTE", "", "'Male'", "."), (None, "the other one", None, "")])
lines_query("det_titles", ("broad",), [("PERSON_TITLE", "told by ", "CASE c_custkey % 2 WHEN 0 THEN 'Dr.' ELSE 'Prof' END", " and others"), (None, "the drum was loud", None, "")])
lines_query("det_fields", ("fields",), [("PERSON_NAME", "case owner: ", PERSON, ""), ("EMAIL", "contact email = ", f"concat('p', {K}, '@x.org')", ""), ("LOCALITY", "follow-up city: ", PLACE, ""), ("POSTCODE", "zip: ", f"concat('57', {K4})", ""), ("CASE_REFERENCE", "ticket reference: ", f"concat('AB-', {K4})", ""), (None, "name: unknown", None, "")])
lines_query("det_inline_fields", ("fields",), [("LOCALITY", "mail=none|city=", PLACE, "|flag=yes"), ("AGE", "x=1; age=", AGE, "; y=2")])
lines_query("det_record_fields", ("fields",), [(None, "key: city", None, ""), ("LOCALITY", "value: ", PLACE, ""), (None, "Organisation", None, ""), ("EMPLOYER", "", f"concat('Firm ', {K})", ""), ("CASE_REFERENCE", "", f"concat('AB-12-', {K4})", " | open")])
lines_query("det_prose", ("fields",), [("CASE_REFERENCE", "the ticket was ", f"concat('ab-2024-', {K4})", ", closed"), ("PERSON_NAME", "the participant ", PERSON, " was late"), ("EMPLOYER", "she works at ", f"concat('Blue Harbour Labs ', {K})", " as an aide"), ("LOCALITY", "a letter from ", PLACE, ", dated")])
lines_query("det_wide", ("wide",), [("PASSPORT_NUMBER", "pasaporte número ", f"concat('AB', {K4}, '56')", ""), ("DATE_OF_BIRTH", "fecha de nacimiento: ", DAY, ""), ("CASE_REFERENCE", "policy number: ", f"concat('PL-', {K4}, '-22')", ""), ("POSTCODE", "zip code ", f"concat('1', {K4})", " east"), ("PERSON_NAME", "my name is ", PERSON, " and so on"), ("PERSON_NAME", "Best regards, ", PERSON, ""), (None, "policy number: none", None, "")])
lines_query("det_semantic", ("semantic",), [("PERSON_NAME", "The note was signed by ", PERSON, "."), ("LOCALITY", "He lives in ", PLACE, " now."), ("JOB_TITLE", "Occupation: ", "CASE c_custkey % 2 WHEN 0 THEN 'Senior Analyst' ELSE 'Field Officer' END", ""), (None, "Nothing was said of it.", None, "")])
# fusion: of what several families find in one place, one mention stays
lines_query("fusion_priorities", (), [("DATE_OF_BIRTH", "Date of Birth: ", "concat('12/03/', cast(1930 + c_custkey % 90 as string))", ""), ("EMAIL", "email: ", f"concat('p', {K}, '@x.org')", ""), ("CASE_REFERENCE", "case reference: ", f"concat('AB-', {K4}, '-17')", ""), ("PAYMENT_CARD_NUMBER", "credit card ", "'4111 1111 1111 1111'", "")])


_TWICE = f"SELECT c_custkey AS doc_id, concat('Full Name: ', {PERSON}, chr(10), 'Witness name: ', {PERSON}) AS text FROM {{customer}}"


@query("fusion_first_pending_name", duck(f"SELECT c_custkey AS doc_id, r.review_status AS review_status, CAST(1 AS BIGINT) AS n FROM {{customer}} CROSS JOIN (VALUES ('PENDING'), ('NOT_REQUIRED')) AS r(review_status)"))
def fusion_first_pending_name(spark, d):
    """Of equal names, the first alone asks for review."""
    found = detect.mentions(fixture(spark, d, _TWICE)).filter("entity_type = 'PERSON_NAME'")
    return found.groupBy("doc_id", "review_status").agg(F.count(F.lit(1)).alias("n"))
