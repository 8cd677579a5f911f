"""The public vocabulary: entity types, levels, audiences, weights and policy, as plain data and DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names and numbers that results must carry.
DIRECT = (
    "PHONE", "EMAIL", "AADHAAR_LIKE", "PAN_LIKE", "PERSON_NAME", "CASE_REFERENCE", "NATIONAL_ID",
    "PASSPORT_NUMBER", "DRIVER_LICENSE_NUMBER", "TAX_IDENTIFIER", "SOCIAL_IDENTIFIER", "PAYMENT_CARD_NUMBER",
)
QUASI = (
    "DATE_OF_BIRTH", "AGE", "STREET_ADDRESS", "LOCALITY", "POSTCODE", "EMPLOYER", "JOB_TITLE", "PERSON_TITLE",
    "GENERIC_DATE", "BUILDING_NUMBER", "DEMOGRAPHIC_ATTRIBUTE",
)
VISUAL = ("FACE", "QR_CODE", "SIGNATURE_CANDIDATE")
ENTITY_TYPES = DIRECT + QUASI + VISUAL
LEVELS = (1, 2, 3, 4, 5)
AUDIENCES = ("PUBLIC_RELEASE", "RESEARCH_PARTNER", "INTERNAL_OPERATIONS")
REVIEW_STATES = ("NOT_REQUIRED", "PENDING", "PROTECT", "IGNORE")
TEST_STATES = ("PASS", "FAIL", "INCONCLUSIVE")
FILE_TYPES = ("PDF", "IMAGE", "TEXT", "DATASET", "DOCX", "VIDEO")
JOB_STATES = ("CREATED", "UPLOADED", "ANALYSED", "HUMAN_REVIEW_REQUIRED", "TRANSFORMED", "VERIFIED_SAFE", "RELEASE_BLOCKED", "DESTROYED", "FAILED")
LEVEL_NAMES = {1: "Level 1 / Direct masking", 2: "Level 2 / Sensitive-entity protection", 3: "Level 3 / Context generalization", 4: "Level 4 / Relationship-safe pseudonymization", 5: "Level 5 / Synthetic Twin generation"}

#: Types compared as collapsed lower-case text, and as upper-case letters and digits.
TEXTUAL = ("PERSON_NAME", "DATE_OF_BIRTH", "AGE", "STREET_ADDRESS", "LOCALITY", "EMPLOYER", "JOB_TITLE", "CASE_REFERENCE", "PERSON_TITLE", "GENERIC_DATE", "DEMOGRAPHIC_ATTRIBUTE")
ALPHANUMERIC = ("NATIONAL_ID", "PASSPORT_NUMBER", "DRIVER_LICENSE_NUMBER", "TAX_IDENTIFIER", "SOCIAL_IDENTIFIER", "PAYMENT_CARD_NUMBER")
#: Types that level 2 protects besides the direct ones.
LEVEL2_QUASI = ("DATE_OF_BIRTH", "STREET_ADDRESS", "POSTCODE", "BUILDING_NUMBER", "GENERIC_DATE", "DEMOGRAPHIC_ATTRIBUTE")
HIGH_RISK = ("AADHAAR_LIKE", "PAN_LIKE", "NATIONAL_ID", "PASSPORT_NUMBER", "DRIVER_LICENSE_NUMBER", "TAX_IDENTIFIER", "SOCIAL_IDENTIFIER", "PAYMENT_CARD_NUMBER")

WEIGHTS = {
    "PERSON_NAME": 22, "PHONE": 18, "EMAIL": 18, "AADHAAR_LIKE": 26, "PAN_LIKE": 24, "CASE_REFERENCE": 17,
    "NATIONAL_ID": 26, "PASSPORT_NUMBER": 25, "DRIVER_LICENSE_NUMBER": 23, "TAX_IDENTIFIER": 24,
    "SOCIAL_IDENTIFIER": 25, "PAYMENT_CARD_NUMBER": 25,
    "DATE_OF_BIRTH": 17, "AGE": 8, "STREET_ADDRESS": 22, "LOCALITY": 11, "POSTCODE": 16, "EMPLOYER": 13,
    "JOB_TITLE": 10, "PERSON_TITLE": 4, "GENERIC_DATE": 8, "BUILDING_NUMBER": 9, "DEMOGRAPHIC_ATTRIBUTE": 7,
    "FACE": 24, "QR_CODE": 20, "SIGNATURE_CANDIDATE": 18,
}
#: Combinations that raise the score; the last is left out of the path list.
COMBINATIONS = (
    (("DATE_OF_BIRTH", "POSTCODE", "EMPLOYER"), 26),
    (("AGE", "LOCALITY", "JOB_TITLE"), 18),
    (("STREET_ADDRESS", "EMPLOYER"), 16),
    (("PERSON_NAME", "CASE_REFERENCE"), 16),
)
PATH_COMBINATIONS = COMBINATIONS[:3]
RELATION_WORDS = ("mother", "father", "spouse", "guardian", "nominee", "witness", "emergency contact")
RESIDUAL = {"REMOVE": 0.03, "MASK": 0.14, "PROTECT": 0.10, "PSEUDONYMIZE": 0.08, "SYNTHESIZE": 0.02, "GENERALIZE": 0.30, "RETAIN": 1.0}
RELATION_FACTOR = {"SYNTHESIZE": 0.04, "PSEUDONYMIZE": 0.12, "PROTECT": 0.16, "MASK": 0.18}
#: Utility lost by an action; some types lose less.
LOSS = {"RETAIN": 0, "PSEUDONYMIZE": 2, "SYNTHESIZE": 2, "PROTECT": 4, "GENERALIZE": 4, "MASK": 3, "REMOVE": 5}
LOSS_LESS = {
    "PSEUDONYMIZE": (1, ("PERSON_NAME", "EMPLOYER", "CASE_REFERENCE")),
    "GENERALIZE": (3, ("DATE_OF_BIRTH", "GENERIC_DATE", "AGE", "LOCALITY", "JOB_TITLE", "PERSON_TITLE", "DEMOGRAPHIC_ATTRIBUTE")),
}
#: Prefix of a protection token where it is not the type's own name.
TOKEN_PREFIX = {
    "PERSON_NAME": "PERSON", "AADHAAR_LIKE": "AADHAAR", "PAN_LIKE": "PAN", "DATE_OF_BIRTH": "DOB", "STREET_ADDRESS": "ADDRESS",
    "BUILDING_NUMBER": "BUILDING", "GENERIC_DATE": "DATE", "DEMOGRAPHIC_ATTRIBUTE": "DEMOGRAPHIC", "PASSPORT_NUMBER": "PASSPORT",
    "DRIVER_LICENSE_NUMBER": "DRIVER_LICENSE", "TAX_IDENTIFIER": "TAX_ID", "SOCIAL_IDENTIFIER": "SOCIAL_ID", "PAYMENT_CARD_NUMBER": "PAYMENT_CARD",
}
#: What a stable alias begins with.
ALIAS_PREFIX = {
    "PERSON_NAME": "Person", "PHONE": "Contact", "EMAIL": "Email alias", "AADHAAR_LIKE": "Credential", "PAN_LIKE": "Tax credential",
    "CASE_REFERENCE": "Case", "EMPLOYER": "Organisation", "NATIONAL_ID": "Identity credential", "PASSPORT_NUMBER": "Passport credential",
    "DRIVER_LICENSE_NUMBER": "Licence credential", "TAX_IDENTIFIER": "Tax credential", "SOCIAL_IDENTIFIER": "Social credential", "PAYMENT_CARD_NUMBER": "Payment credential",
}
REMOVED_TEXT = {"FACE": "FACE PROTECTED", "QR_CODE": "QR REMOVED", "SIGNATURE_CANDIDATE": "SIGNATURE PROTECTED"}


def family(entity_type: str) -> str:
    return "DIRECT" if entity_type in DIRECT else "QUASI" if entity_type in QUASI else "VISUAL"


def action(entity_type: str, level: int, audience: str) -> str:
    """What a level does to a type for an audience; total over all three."""
    kind = family(entity_type)
    if kind == "VISUAL":
        return "REMOVE"
    if level == 5:
        return "SYNTHESIZE"
    if kind == "DIRECT":
        return {1: "MASK", 2: "PROTECT", 3: "MASK", 4: "PSEUDONYMIZE"}[level]
    if level == 1 or level == 2 and entity_type not in LEVEL2_QUASI:
        return "RETAIN"
    if level == 2:
        return "PROTECT"
    if level == 3 and audience == "INTERNAL_OPERATIONS" and entity_type in ("EMPLOYER", "JOB_TITLE"):
        return "RETAIN"
    return "PSEUDONYMIZE" if level == 4 and entity_type == "EMPLOYER" else "GENERALIZE"


def utility_loss(entity_type: str, what: str) -> int:
    less, types = LOSS_LESS.get(what, (0, ()))
    return less if entity_type in types else LOSS[what]


def policy_rows() -> list[tuple[str, str, int, str, str, float, int, int]]:
    return [(t, family(t), level, audience, a, RESIDUAL[a], utility_loss(t, a), WEIGHTS[t]) for t in ENTITY_TYPES for level in LEVELS for audience in AUDIENCES for a in [action(t, level, audience)]]


def policy_table(spark: SparkSession) -> DataFrame:
    """390 rows: the whole policy, to be broadcast (its size is fixed)."""
    return spark.createDataFrame(policy_rows(), "entity_type string, family string, level int, audience string, action string, residual double, loss int, weight int")
