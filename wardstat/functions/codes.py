"""Domain constants.

FIXED VALUES: everything in this module is data that has to equal the
study's own definitions for results to match (code lists, label maps,
ranges).  They are written once, plainly, in their natural order.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES: missing-value markers
# --------------------------------------------------------------------------
MARKER = "?"
# tokens a CSV reader of the study treats as missing on load
NA_TOKENS = ("None", "")

# --------------------------------------------------------------------------
# FIXED VALUES: ICD-9 diagnosis groups, checked in this order.
# (category, [(low, high) inclusive ranges], [exact codes])
# Diabetes is 250 <= x < 251 (half-open), handled separately below.
# --------------------------------------------------------------------------
ICD9_GROUPS = [
    ("Circulatory", [(390, 459)], [785]),
    ("Respiratory", [(460, 519)], [786]),
    ("Digestive", [(520, 579)], [787]),
    ("Diabetes", [], []),  # 250 <= x < 251
    ("Injury", [(800, 999)], []),
    ("Musculoskeletal", [(710, 739)], []),
    ("Genitourinary", [(580, 629)], [788]),
    ("Neoplasms", [(140, 239)], []),
]
ICD9_NULL_CATEGORY = "0"
ICD9_OTHER = "Other"
# text accepted as a number by the study's float() parse after trimming
ICD9_NUMERIC_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"

# --------------------------------------------------------------------------
# FIXED VALUES: diabetes codes -> (type, description), in natural order.
# --------------------------------------------------------------------------
DIABETES_DEFAULT_CODE = "250"
DIABETES_CODES = [
    ("250", 2, "Diabetes mellitus without mention of complication, type II or unspecified type, not stated as uncontrolled (250.00)"),
    ("250.01", 1, "Diabetes mellitus without mention of complication, type I [juvenile type], not stated as uncontrolled (250.01)"),
    ("250.02", 2, "Diabetes mellitus without mention of complication, type II or unspecified type, uncontrolled (250.02)"),
    ("250.03", 1, "Diabetes mellitus without mention of complication, type I [juvenile type], uncontrolled (250.03)"),
    ("250.1", 2, "Diabetes with ketoacidosis, type II or unspecified type, not stated as uncontrolled (250.10)"),
    ("250.11", 1, "Diabetes with ketoacidosis, type I [juvenile type], not stated as uncontrolled (250.11)"),
    ("250.12", 2, "Diabetes with ketoacidosis, type II or unspecified type, uncontrolled (250.12)"),
    ("250.13", 1, "Diabetes with ketoacidosis, type I [juvenile type], uncontrolled (250.13)"),
    ("250.2", 2, "Diabetes with hyperosmolarity, type II or unspecified type, not stated as uncontrolled (250.20)"),
    ("250.21", 1, "Diabetes with hyperosmolarity, type I [juvenile type], not stated as uncontrolled (250.21)"),
    ("250.22", 2, "Diabetes with hyperosmolarity, type II or unspecified type, uncontrolled (250.22)"),
    ("250.23", 1, "Diabetes with hyperosmolarity, type I [juvenile type], uncontrolled (250.23)"),
    ("250.3", 2, "Diabetes with other coma, type II or unspecified type, not stated as uncontrolled (250.30)"),
    ("250.31", 1, "Diabetes with other coma, type I [juvenile type], not stated as uncontrolled (250.31)"),
    ("250.32", 2, "Diabetes with other coma, type II or unspecified type, uncontrolled (250.32)"),
    ("250.33", 1, "Diabetes with other coma, type I [juvenile type], uncontrolled (250.33)"),
    ("250.4", 2, "Diabetes with renal manifestations, type II or unspecified type, not stated as uncontrolled (250.40)"),
    ("250.41", 1, "Diabetes with renal manifestations, type I [juvenile type], not stated as uncontrolled (250.41)"),
    ("250.42", 2, "Diabetes with renal manifestations, type II or unspecified type, uncontrolled (250.42)"),
    ("250.43", 1, "Diabetes with renal manifestations, type I [juvenile type], uncontrolled (250.43)"),
    ("250.5", 2, "Diabetes with ophthalmic manifestations, type II or unspecified type, not stated as uncontrolled (250.50)"),
    ("250.51", 1, "Diabetes with ophthalmic manifestations, type I [juvenile type], not stated as uncontrolled (250.51)"),
    ("250.52", 2, "Diabetes with ophthalmic manifestations, type II or unspecified type, uncontrolled (250.52)"),
    ("250.53", 1, "Diabetes with ophthalmic manifestations, type I [juvenile type], uncontrolled (250.53)"),
    ("250.6", 2, "Diabetes with neurological manifestations, type II or unspecified type, not stated as uncontrolled (250.60)"),
    ("250.7", 2, "Diabetes with peripheral circulatory disorders, type II or unspecified type, not stated as uncontrolled (250.70)"),
    ("250.8", 2, "Diabetes with other specified manifestations, type II or unspecified type, not stated as uncontrolled (250.80)"),
    ("250.81", 1, "Diabetes with other specified manifestations, type I [juvenile type], not stated as uncontrolled (250.81)"),
    ("250.82", 2, "Diabetes with other specified manifestations, type II or unspecified type, uncontrolled (250.82)"),
    ("250.83", 1, "Diabetes with other specified manifestations, type I [juvenile type], uncontrolled (250.83)"),
    ("250.9", 2, "Diabetes with unspecified complication, type II or unspecified type, not stated as uncontrolled (250.90)"),
    ("250.91", 1, "Diabetes with unspecified complication, type I [juvenile type], not stated as uncontrolled (250.91)"),
    ("250.92", 2, "Diabetes with unspecified complication, type II or unspecified type, uncontrolled (250.92)"),
    ("250.93", 1, "Diabetes with unspecified complication, type I [juvenile type], uncontrolled (250.93)"),
]
CONTROL_PHRASE = "not stated as uncontrolled"
COMPLICATION_PHRASE = " with "
NO_COMPLICATION = "None"

# --------------------------------------------------------------------------
# FIXED VALUES: ID label maps of the neural path (after code merging)
# --------------------------------------------------------------------------
ADMISSION_TYPE_MERGE = {5: 9, 6: 9, 8: 9}
ADMISSION_TYPE_LABELS = {
    1: "Emergency",
    2: "Urgent",
    3: "Elective",
    4: "Newborn",
    7: "Trauma Center",
    9: "Not available",
}
DISCHARGE_LABELS = {
    1: "Home",
    2: "Transfer Short-term Hospital",
    3: "Transfer SNF",
    4: "Transfer ICF",
    5: "Transfer Other Inpatient Facility",
    6: "Home Health Service",
    7: "Left AMA",
    8: "Home IV Care",
    9: "Admitted as Inpatient Here",
    10: "Neonate Aftercare Transfer",
    11: "Expired",
    12: "Still Patient / Outpatient Followup Planned",
    13: "Hospice Home",
    14: "Hospice Medical Facility",
    15: "Swing Bed (Medicare)",
    16: "Transfer for Outpatient Services (Other Institution)",
    17: "Transfer for Outpatient Services (This Institution)",
    18: "NULL",
    19: "Expired at Home (Hospice)",
    20: "Expired in Facility (Hospice)",
    21: "Expired - Place Unknown (Hospice)",
    22: "Rehab Facility",
    23: "Long Term Care Hospital",
    24: "Nursing Facility (Medicaid only)",
    25: "Not Mapped",
    26: "Unknown/Invalid",
    27: "Federal Health Care Facility",
    28: "Psych Hospital / Psych Unit",
    29: "Critical Access Hospital",
    30: "Other Health Care Institution",
}
ADMISSION_SOURCE_MERGE = {9: 27, 15: 27, 17: 27, 20: 27}
ADMISSION_SOURCE_LABELS = {
    1: "Physician Referral",
    2: "Clinic Referral",
    3: "HMO Referral",
    4: "Transfer from Hospital",
    5: "Transfer from SNF",
    6: "Transfer from Other Facility",
    7: "Emergency Room",
    8: "Court/Law Enforcement",
    10: "Transfer from critical access hospital",
    11: "Normal Delivery",
    12: "Premature Delivery",
    13: "Sick Baby",
    14: "Extramural Birth",
    18: "Transfer From Another Home Health Agency",
    19: "Readmission to Same Home Health Agency",
    21: "Unknown/Invalid",
    22: "Transfer from Hospital Inpatient / Same Facility",
    23: "Born Inside This Hospital",
    24: "Born Outside This Hospital",
    25: "Transfer from Ambulatory Surgery Center",
    26: "Transfer from Hospice",
    27: "Not available",
}
# label texts that mean "no information" in the sectioned ID map
MISSING_LABEL_PATTERN = r"(?i)^(null|not available|not mapped|unknown/invalid|unknown|invalid)$"
MISSING_LABEL = "Missing"

# --------------------------------------------------------------------------
# FIXED VALUES: discharge / admission code sets
# --------------------------------------------------------------------------
DEAD_OR_HOSPICE = [11, 13, 14, 19, 20, 21]
DISCHARGE_HOME = [1, 6, 8]
DISCHARGE_POSTACUTE = [3, 4, 5, 15, 22, 23, 24, 29, 30]
DISCHARGE_PSYCH = [28]
ADMIT_EMERGENT = [1, 2, 7]
ADMIT_ELECTIVE = [3]
ADMIT_TRANSFER_SOURCE = [5, 6]
EXCLUDED_AGE_BANDS = ["[0-10)", "[10-20)", "[90-100)"]
A1C_BAD = [">8", ">9"]
# inclusive bounds of the neural path's range trim
RANGE_TRIM = {"num_lab_procedures": (None, 99), "num_medications": (None, 63),
              "number_diagnoses": (2, 9)}
MAX_ENCOUNTERS_PER_PATIENT = 13

# --------------------------------------------------------------------------
# FIXED VALUES: medication columns (natural order of the raw table) and the
# three drug groups of the medication-change analysis.
# --------------------------------------------------------------------------
MEDICATIONS = [
    "metformin", "repaglinide", "nateglinide", "chlorpropamide", "glimepiride",
    "acetohexamide", "glipizide", "glyburide", "tolbutamide", "pioglitazone",
    "rosiglitazone", "acarbose", "miglitol", "troglitazone", "tolazamide",
    "examide", "citoglipton", "insulin", "glyburide-metformin",
    "glipizide-metformin", "glimepiride-pioglitazone", "metformin-rosiglitazone",
    "metformin-pioglitazone",
]
CONSTANT_MEDICATIONS = ["examide", "citoglipton"]
DRUG_GROUPS = {
    "insulin_sensitivity_change": [
        "metformin", "pioglitazone", "rosiglitazone", "troglitazone",
        "glimepiride-pioglitazone", "metformin-rosiglitazone", "metformin-pioglitazone",
    ],
    "insulin_production_change": [
        "chlorpropamide", "glimepiride", "glipizide", "glyburide", "tolbutamide",
        "acetohexamide", "tolazamide", "repaglinide", "nateglinide",
        "examide", "insulin", "citoglipton",
        "glyburide-metformin", "glipizide-metformin", "glimepiride-pioglitazone",
    ],
    "sugar_assimilation_change": ["acarbose", "miglitol"],
}
MULTIPLE_CHANGES = "Multiple changes"

# medication-per-day bins of the analysis step (right-closed)
MEDICATION_BINS = [0, 5, 10, 15, 20, 100]
MEDICATION_BIN_LABELS = ["1-5", "6-10", "11-15", "16-20", "20+"]

# columns never used as features (ids and target text)
ID_COLUMNS = ["encounter_id", "patient_nbr"]
TARGET_TEXT = "readmitted"
TARGET = "readmitted_binary"
POSITIVE_TEXT = "<30"
