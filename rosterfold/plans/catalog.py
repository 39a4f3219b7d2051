"""The yearly health-center survey: its sheets, columns and reported measures."""

from __future__ import annotations

from rosterfold.operators.measures import (
    Measure,
    mean,
    reported,
    row_total,
    suppressed,
    total,
    weighted_ratio,
)
from rosterfold.plans.facts import FactColumns

KEY = "GrantNumber"
YEAR = "ReportingYear"
STATE = "HealthCenterState"
BADGE_KEY = "Grant Number"

#: Decimals of reported cells: counts, staff in hundredths, amounts.
PLACES = 2

# Member organisations by grant number.
ROSTER = (
    "H80CS02327", "H80CS29016", "H80CS26615", "H80CS00773",
    "H80CS26574", "H80CS02326", "H80CS00358", "H80CS04290",
    "H80CS00722", "H80CS28986", "H80CS02468", "H80CS06640",
    "H80CS24153", "H80CS00437", "H80CS31624", "H80CS00814",
    "H80CS00776", "H80CS33646", "H80CS35350", "H80CS08775",
    "H80CS00397", "H80CS26582", "H80CS00221", "H80CS26623",
    "H80CS00600", "H80CS06653", "H80CS00807", "H80CS00646",
)

# Reporting years, and the directory name of a year's workbook.
YEARS = ("2021", "2022", "2023", "2024")
WORKBOOK = "{root}/H80{year}"

# The info sheet and its columns; all but the funding flags are text.
INFO_SHEET = "HealthCenterInfo"
INFO_TEXT = (
    "GrantNumber", "ReportingYear", "HealthCenterName", "HealthCenterCity",
    "HealthCenterState", "HealthCenterZIPCode", "UrbanRuralFlag",
)
INFO_NUMBERS = ("FundingCHC", "FundingMHC", "FundingHO", "FundingPH")

# Table sheets, and the positions read (None: all but the first).
TABLE_SHEETS = {
    "Table3A": None,
    "Table3B": None,
    "Table4": range(2, 31),
    "Table5": None,
    "Table6A": None,
    "Table6B": None,
    "Table6BClinicalmeasures": None,
    "Table7_1": None,
    "Table7_2": None,
    "Table8A": None,
    "Table9E": None,
    "HITInformation": None,
    "OtherDataElements": None,
    "Workforce": None,
}

# States in the published column order, most organisations first.
STATE_ORDER = ("CA", "HI", "NY", "FM", "MA", "GU", "MP", "AR", "IL", "LA", "OH", "TX", "WA")

# Badge years and levels.
BADGE_YEARS = ("2022", "2023", "2024", "2025")
BADGE_LEVELS = ("Gold", "Silver", "Bronze")
BADGE_COLUMN = "Health Center Quality Leader - {level}_{year}"
BADGE_SHEET = "{year} CHQR Data"


def badge_columns() -> list[str]:
    return [
        BADGE_COLUMN.format(level=level, year=year) for level in BADGE_LEVELS for year in BADGE_YEARS
    ]


def _lines(table: str, lines, columns=("Ca", "Cb")) -> list[str]:
    return [f"{table}_L{line}_{c}" for line in lines for c in columns]


# Age bands as first and last line of table 3A.
AGE_BANDS = {
    "age_under_1": (1, 1),
    "age_1_4": (2, 5),
    "age_5_12": (6, 13),
    "age_13_19": (14, 20),
    "age_20_29": (21, 26),
    "age_30_39": (27, 28),
    "age_40_49": (29, 30),
    "age_50_59": (31, 32),
    "age_60_64": (33, 33),
    "age_65_up": (34, 38),
}

TABLE_3A = [
    row_total("patients", _lines("T3a", ["39"])),
    total("male", "T3a_L39_Ca"),
    total("female", "T3a_L39_Cb"),
    *[
        row_total(band, _lines("T3a", range(first, last + 1)))
        for band, (first, last) in AGE_BANDS.items()
    ],
]

# Lines of table 3B by measure.
TABLE_3B = [
    total("asian", "T3b_L1_Cd"),
    total("native_hawaiian", "T3b_L2a_Cd"),
    total("pacific_islander", "T3b_L2b_Cd"),
    total("black", "T3b_L3_Cd"),
    total("american_indian_alaska_native", "T3b_L4_Cd"),
    total("white", "T3b_L5_Cd"),
    total("more_than_one_race", "T3b_L6_Cd"),
    total("unreported_race", "T3b_L7_Cd"),
    total("other_language", "T3b_L12_Ca"),
]

# Detailed groups and the lines that report them.
ASIAN_DETAIL = {
    "Asian_Indian": "T3b_L1a_Cd",
    "Chinese": "T3b_L1b_Cd",
    "Filipino": "T3b_L1c_Cd",
    "Japanese": "T3b_L1d_Cd",
    "Korean": "T3b_L1e_Cd",
    "Vietnamese": "T3b_L1f_Cd",
    "Other_Asian": "T3b_L1g_Cd",
}
ASIAN_WITH_TOTAL = {**ASIAN_DETAIL, "Total_Asian": "T3b_L1_Cd"}
PACIFIC_DETAIL = {
    "Native_Hawaiian": "T3b_L2a_Cd",
    "Other_Pacific_Islander": "T3b_L2b_Cd",
    "Guamanian_or_Chamorro": "T3b_L2c_Cd",
    "Samoan": "T3b_L2d_Cd",
}
PACIFIC_WITH_TOTAL = {**PACIFIC_DETAIL, "Total_NH_and_Other_Pacific_islander": "T3b_L2_Cd"}

DETAIL_ASIAN = [total(n, c) for n, c in ASIAN_WITH_TOTAL.items()]
DETAIL_ASIAN_REPORTED = [reported(n, c) for n, c in ASIAN_WITH_TOTAL.items()]
DETAIL_ASIAN_SUPPRESSED = [suppressed(n, c) for n, c in ASIAN_WITH_TOTAL.items()]
DETAIL_PACIFIC = [total(n, c) for n, c in PACIFIC_WITH_TOTAL.items()]
DETAIL_BY_STATE = [total(n, c) for n, c in {**ASIAN_DETAIL, **PACIFIC_DETAIL}.items()]

# Lines of table 4 by measure.
TABLE_4 = [
    row_total("fpl_101_200", ["T4_L2_Ca", "T4_L3_Ca"]),
    total("fpl_over_200", "T4_L4_Ca"),
    total("uninsured_0_17", "T4_L7_Ca"),
    total("uninsured_18_up", "T4_L7_Cb"),
    total("medicaid_0_17", "T4_L8_Ca"),
    total("medicaid_18_up", "T4_L8_Cb"),
    row_total("medicaid", _lines("T4", ["8"])),
    row_total("dually_eligible", _lines("T4", ["9a"])),
    row_total("medicare", _lines("T4", ["9"])),
    row_total("other_public_non_chip", _lines("T4", ["10a"])),
    row_total("other_public_chip", _lines("T4", ["10"])),
    row_total("public_insurance", _lines("T4", ["10b"])),
    # the published total names the under-18 column twice and counts it once
    row_total("private_insurance", ["T4_L11_Ca", "T4_L11_Ca"]),
]
# the total with both age columns, for those who want it corrected
PRIVATE_INSURANCE_ALL_AGES = row_total("private_insurance", _lines("T4", ["11"]))

# Staff and patients by line of table 5.
STAFF = {
    "family_physicians": "T5_L1_Ca",
    "general_practitioners": "T5_L2_Ca",
    "internists": "T5_L3_Ca",
    "obgyns": "T5_L4_Ca",
    "pediatricians": "T5_L5_Ca",
    "other_specialists": "T5_L7_Ca",
    "physicians": "T5_L8_Ca",
    "np_pa_cnm": "T5_L10a_Ca",
    "medical_fte": "T5_L15_Ca",
    "medical_patients": "T5_L15_Cc",
    "dental_fte": "T5_L19_Ca",
    "dental_patients": "T5_L19_Cc",
    "mental_health_fte": "T5_L20_Ca",
    "mental_health_patients": "T5_L20_Cc",
    "substance_use_fte": "T5_L21_Ca",
    "substance_use_patients": "T5_L21_Cc",
    "vision_fte": "T5_L22d_Ca",
    "vision_patients": "T5_L22d_Cc",
    "pharmacy_fte": "T5_L23_Ca",
    "enabling_fte": "T5_L29_Ca",
    "case_managers": "T5_L24_Ca",
    "health_educators": "T5_L25_Ca",
    "outreach_workers": "T5_L26_Ca",
    "transport_staff": "T5_L27_Ca",
    "eligibility_workers": "T5_L27a_Ca",
    "interpreters": "T5_L27b_Ca",
    "community_health_workers": "T5_L27c_Ca",
    "other_enabling": "T5_L28_Ca",
}
TABLE_5 = [total(n, c) for n, c in STAFF.items()]
# Physician lines of table 5 and their total.
PHYSICIAN_PARTS = tuple(f"T5_L{line}_Ca" for line in (1, 2, 3, 4, 5, 7))
PHYSICIAN_TOTAL = "T5_L8_Ca"
PHYSICIAN_MEANS = [
    mean(n, c, digits=2)
    for n, c in zip(("FM", "GP", "IM", "OBGYN", "Peds", "OtherSpec"), PHYSICIAN_PARTS)
]
# Published with the physician lines; pass the right ones where they are known
PHARMACY_DETAIL = [
    total("ClinicalPharm", "T5_L1_Ca"),
    total("PharmTech", "T5_L2_Ca"),
    total("OtherPharmPersonnel", "T5_L3_Ca"),
    total("TotalPharmPersonnel", "T5_L4_Ca"),
]

# Lines of table 6A by measure.
TABLE_6A = [
    total("tuberculosis", "T6a_L3_Cb"),
    total("hepatitis_b", "T6a_L4a_Cb"),
    total("asthma", "T6a_L5_Cb"),
    total("diabetes", "T6a_L9_Cb"),
    total("heart_disease", "T6a_L10_Cb"),
    total("hypertension", "T6a_L11_Cb"),
    total("heat_cold_visits", "T6a_L14_Ca"),
    total("overweight", "T6a_L14a_Cb"),
    total("perinatal", "T6a_L16_Cb"),
    total("alcohol", "T6a_L18_Cb"),
    total("intimate_partner_violence", "T6a_L20f_Cb"),
]

# Clinical percentage columns.
CLINICAL = {
    "pap_test": "%ofPatientstestedPap",
    "mammogram": "%ofPatientswithMammogram",
    "child_bmi": "%ChildrenandAdolescentswithDocumentedCounselingandBMIPercentile",
    "adult_bmi": "%AdultswithDocumentedBMIandFollow-upPlanIfWeightisOutsideParameters",
    "tobacco": "%PatientsAssessedforTobaccoUseandProvidedInterventionIfaTobaccoUser",
    "statin": "%ofPatientsPrescribedOrOnStatinTherapy",
    "ischemic_vascular": "%ofAdults18andolderwithIVDwithDocumentationOfAspirinOrOtherAntiplateletTherapy",
    "colorectal": "%ofAdultswithAppropriateScreeningforColorectalCancer",
    "hiv_30_days": "%PatientsSeenWithin30DaysofFirstDiagnosisofHIV",
    "hiv_test": "%PatientsTestedforHIV",
    "depression_screen": "%%PatientsScreenedforDepressionandFollowupPlanDocumentedasAppropriate",
    "depression_remission": "%PatientswhoReachedRemission",
    "dental_sealant": "%PatientsAged6-9WithSealantsToFirstMolars",
}
TABLE_6B = [mean(n, c) for n, c in CLINICAL.items()]

# Columns of the controlled and uncontrolled ratios: part, base, weight.
CONTROL = ("T7_Li_C2c", "T7_Li_C2b", "T7_Li_C2a")
UNCONTROLLED = ("T7_Li_C3f", "T7_Li_C3b", "T7_Li_C3a")
TABLE_7 = [
    weighted_ratio("hypertension_control", *CONTROL),
    weighted_ratio("diabetes_uncontrolled", *UNCONTROLLED),
]

# Cost lines of table 8A.
COSTS = {
    "medical_cost": "4",
    "dental_cost": "5",
    "mental_health_cost": "6",
    "substance_use_cost": "7",
    "pharmacy_cost": "8a",
    "pharmaceuticals_cost": "8b",
    "other_professional_cost": "9",
    "vision_cost": "9a",
    "case_management_cost": "11a",
    "transport_cost": "11b",
    "outreach_cost": "11c",
    "education_cost": "11d",
    "eligibility_cost": "11e",
    "interpretation_cost": "11f",
    "other_enabling_cost": "11g",
    "community_health_worker_cost": "11h",
}
TABLE_8A = [total(n, f"T8a_L{line}_Cc") for n, line in COSTS.items()]

# Table 9D is not among the loaded sheets; its measures need it added
TABLE_9D = [
    total("medicaid_collected", "T9D_L3_Cb"),
    total("medicare_collected", "T9D_L6_Cb"),
    total("other_public_collected", "T9D_L9_Cb"),
    total("private_collected", "T9D_L12_Cb"),
    total("self_pay_collected", "T9D_L13_Cb"),
]
TABLE_9E = [total("other_revenue", "T9E_L11_Ca")]

# Workforce lines 2.1 to 2.25 with both columns, except that of line 2.11 only
# Cb is counted; lines 2.1a to 2.1f have Cb, line 2.10a has both.
WORKFORCE_COLUMNS = (
    _lines("Twfc", ["2.1"])
    + _lines("Twfc", [f"2.1{x}" for x in "abcdef"], ["Cb"])
    + _lines("Twfc", [f"2.{n}" for n in range(2, 11)] + ["2.10a"])
    + ["Twfc_L2.11_Cb"]
    + _lines("Twfc", [f"2.{n}" for n in range(12, 26)])
)
WORKFORCE = [row_total("pre_post_grad", WORKFORCE_COLUMNS)]

YEARLY: list[Measure] = [
    *TABLE_3A,
    *TABLE_3B,
    *TABLE_4,
    *TABLE_5,
    *TABLE_6A,
    *TABLE_6B,
    *TABLE_7,
    *TABLE_8A,
    *TABLE_9D,
    *TABLE_9E,
    *WORKFORCE,
]

FACTS = FactColumns(
    key=KEY,
    year=YEAR,
    patients=("T3a_L39_Ca", "T3a_L39_Cb"),
    minority=(
        "T3b_L1_Cd", "T3b_L2a_Cd", "T3b_L2b_Cd", "T3b_L3_Cd", "T3b_L4_Cd", "T3b_L6_Cd", "T3b_L5_Ca",
    ),
    public_insurance=("T4_L10b_Ca", "T4_L10b_Cb"),
    uninsured=("T4_L7_Ca", "T4_L7_Cb"),
    over_poverty=("T4_L2_Ca", "T4_L3_Ca", "T4_L4_Ca"),
    other_language="T3b_L12_Ca",
    control=CONTROL,
    uncontrolled=UNCONTROLLED,
    cost="T8a_L17_Cc",
    fte="T5_L34_Ca",
)

PROFILED = ("T3b_L1_Cd", "T3b_L2a_Cd", "T3b_L2b_Cd")
ROW_TOTAL_COLUMNS = ("T3b_L1_Cd", "T3b_L2_Cd")
