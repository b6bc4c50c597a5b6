"""Code lists, crosswalks, column roles, weights and prompt texts.

Everything here must keep its value for results to be comparable between survey years.
"""

from pyspark.sql import types as T

# Columns of the canonical trip table, in order.
CANONICAL_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("household_id", T.StringType()),
    T.StructField("person_id", T.StringType()),
    T.StructField("trip_no", T.IntegerType()),
    T.StructField("survey_year", T.IntegerType()),
    T.StructField("hh_size", T.IntegerType()),
    T.StructField("car_availability", T.IntegerType()),
    T.StructField("age_group", T.IntegerType()),
    T.StructField("sex", T.IntegerType()),
    T.StructField("employment_status", T.IntegerType()),
    T.StructField("income_group", T.IntegerType()),
    T.StructField("trip_purpose", T.IntegerType()),
    T.StructField("departure_period", T.IntegerType()),
    T.StructField("journey_time", T.DoubleType()),
    T.StructField("origin_zone", T.StringType()),
    T.StructField("destination_zone", T.StringType()),
    T.StructField("main_mode", T.IntegerType()),
    T.StructField("trip_weight", T.DoubleType()),
    T.StructField("raw_mode_2011", T.StringType()),
    T.StructField("raw_purpose_2011", T.StringType()),
])
CANONICAL_COLUMNS = CANONICAL_SCHEMA.fieldNames()

# Roles of the canonical columns.
CATEGORICAL_COLUMNS = [
    "age_group", "sex", "employment_status", "income_group",
    "car_availability", "trip_purpose", "departure_period",
]
NUMERIC_COLUMNS = ["journey_time", "hh_size"]
FEATURE_COLUMNS = [
    "age_group", "sex", "employment_status", "income_group",
    "car_availability", "hh_size",
    "trip_purpose", "departure_period", "journey_time",
]
TARGET_COLUMN = "main_mode"
RETRIEVAL_FEATURES = [
    "car_availability", "age_group", "employment_status", "trip_purpose",
    "origin_zone_int", "dest_zone_int", "sex", "departure_period",
]
MODEL_FEATURES = [
    "car_availability", "age_group", "employment_status", "trip_purpose",
    "origin_zone_int", "dest_zone_int", "journey_time", "sex", "departure_period",
]
SUBGROUP_COLUMNS = ["age_group", "sex", "employment_status"]
ALL_SUBGROUP_COLUMNS = SUBGROUP_COLUMNS + ["income_group", "car_availability"]

# Code lists.
MODE_LABELS = {
    1: "Rail", 2: "LRT", 3: "Tram", 4: "Ferry", 5: "PLB",
    6: "Bus", 7: "Private Vehicle", 8: "Taxi", 9: "SPB",
}
PURPOSE_LABELS = {1: "Work", 2: "Education", 7: "Other"}
AGE_LABELS = {1: "0-14", 2: "15-24", 3: "25-44", 4: "45-64", 5: "65+"}
SEX_LABELS = {1: "Male", 2: "Female"}
EMPLOYMENT_LABELS = {
    1: "Full-time", 2: "Part-time", 3: "Self-emp", 4: "Student",
    5: "Homemaker", 6: "Retired", 7: "Other",
}
INCOME_LABELS = {0: "Unknown", 1: "Low", 2: "Lower-mid", 3: "Middle", 4: "Upper-mid", 5: "High"}
PERIOD_LABELS = {1: "AM Peak", 2: "Inter-peak", 3: "PM Peak", 4: "Off-peak"}
CAR_LABELS = {0: "No car", 1: "1 car", 2: "2+ cars"}
MODES = list(MODE_LABELS)
PURPOSES = list(PURPOSE_LABELS)
ILLEGAL_MODE_CODES = [10, 99, 999]

# Raw code -> canonical code, per field and survey year.
CROSSWALKS = {
    ("main_mode", 2011): {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9},
    ("main_mode", 2022): {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9},
    ("trip_purpose", 2011): {1: 1, 2: 2, 3: 7, 4: 1, 5: 7},
    ("trip_purpose", 2022): {1: 1, 2: 2, 3: 7, 4: 1, 5: 7},
    ("employment_status", 2011): {1: 1, 2: 2, 3: 4, 4: 5, 5: 6, 6: 7},
    ("employment_status", 2022): {1: 1, 2: 2, 3: 4, 4: 5, 5: 6, 6: 7},
    ("income_group", 2011): {
        1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3, 8: 3, 9: 3, 10: 4,
        11: 4, 12: 4, 13: 4, 14: 5, 15: 5, 16: 5, 17: 5, 18: 5, 19: 5, 97: 0,
    },
    ("departure_period", 2011): {1: 1, 2: 2, 3: 3, 4: 4},
    ("departure_period", 2022): {1: 1, 2: 2, 3: 3, 4: 4},
    ("sex", 2011): {1: 1, 2: 2},
    ("sex", 2022): {1: 1, 2: 2},
}

# Raw column names by role, per survey year.
SURVEY_2011 = {
    "year": 2011,
    "household": {
        "household_id": "Q_NO", "hh_size": "A3", "hh_income": "B15", "hh_weight": "WT_HH",
        "zone": "HH_TPUSB", "car_cols": ["C2A1", "C2A2", "C2B1", "C2B2", "C2C1", "C2C2"],
    },
    "member": {
        "household_id": "Q_NO", "member_id": "MEM", "sex": "B1", "age": "B2",
        "employment": "E_Status", "member_weight": "WT_MEM", "urban_rural": "UR_MR",
    },
    "trip": {
        "household_id": "Q_NO", "member_id": "MEM", "trip_no": "Trip_no",
        "trip_purpose": "Pur", "main_mode": "Mode_Hier", "depart_time": "Deptm",
        "arrive_time": "Arrtm", "journey_time": "Joutm", "origin_lookup": "D5",
        "dest_lookup": "D6", "time_period": "TiPer", "trip_weight": "WT_TRIP",
        "origin_zone": "origin_db26", "dest_zone": "dest_db26",
    },
    "lookup": {"zone": "11TPUSB", "district": "DB26"},
}
SURVEY_2022 = {
    "year": 2022,
    "household": {
        "household_id": "Q_no", "hh_type": "HH_Type", "hh_weight": "WT_HH", "hh_size": "A3",
        "zone": "HH_TPUSB", "car_cols": ["C1A1", "C1A2", "C1A3", "C1A4", "C1A5"],
    },
    "member": {
        "household_id": "Q_no", "member_id": "Mem", "hh_relation": "A4", "sex": "B1",
        "age": "B2", "employment": "E_status", "member_weight": "WT_MEM", "urban_rural": "UR_MR",
    },
    "trip": {
        "household_id": "Q_no", "member_id": "Mem", "trip_no": "Trip_no",
        "trip_purpose": "T_Pur", "main_mode": "Main_mode", "depart_time": "D7",
        "arrive_time": "D8", "journey_time": "Journey Time", "origin_zone": "O_26PDD",
        "dest_zone": "D_26PDD", "time_period": "4_Pks", "trip_weight": "WT_TRIP",
    },
}

# Limits, score weights, experiment grid.
MAX_RAW_MODE = 9
MAX_JOURNEY_MINUTES = 240.0
LAMBDA_SIMILARITY, LAMBDA_SHIFT, LAMBDA_PRIORITY = 0.5, 0.3, 0.2
TARGET_YEAR, HISTORICAL_YEAR = 2022, 2011
TOP_K = 8
N_PROTOTYPES = 10
TEST_RATIO = 0.2
FEWSHOT_RATIOS = [0.01, 0.05, 0.10]
SEEDS = [42, 123, 456]
NLL_EPSILON = 2.220446049250313e-16
JS_SMOOTHING = 1e-10
REPORT_METRICS = ["accuracy", "macro_f1", "mode_share_mae", "mode_share_js"]

# Prompt texts of the evidence-based and of the profile-only predictor.
EVIDENCE_SYSTEM_PROMPT = """You are an expert in Hong Kong travel behavior analysis with access to historical travel survey data.

Your task is to predict the main transport mode for a traveler based on:
1. Their demographic profile and household characteristics
2. The trip context (purpose, time, origin/destination)
3. Historical behavioral patterns from similar travelers
4. Recent travel observations from the current survey period

Available transport modes:
  1: Rail
  2: LRT
  3: Tram
  4: Ferry
  5: PLB
  6: Bus
  7: Private Vehicle
  8: Taxi
  9: SPB

IMPORTANT: You MUST respond ONLY with valid JSON using exactly this structure:
{"predicted_mode": <integer mode code>, "confidence": <float between 0 and 1>, "reasoning_brief": "<one sentence explanation>"}

Do NOT include any text outside the JSON object."""

EVIDENCE_USER_PROMPT = """=== QUERY: Traveler to Predict ===
Person characteristics:
  - Age group: {age_group}
  - Sex: {sex}
  - Employment: {employment_status}
  - Income level: {income_group}
  - Household car availability: {car_availability}

Trip characteristics:
  - Purpose: {trip_purpose}
  - Departure time: {departure_period}
  - Estimated journey time: {journey_time}

=== HISTORICAL BEHAVIORAL PRIOR (TCS 2011) ===
{prototype_summary}

=== SIMILAR HISTORICAL TRAVELERS (TCS 2011) ===
{historical_examples}

=== RECENT TRAVELERS FROM CURRENT SURVEY (TCS 2022 few-shot) ===
{update_examples}

Based on all the above evidence, predict the main transport mode for this traveler.
Respond with JSON only."""

PROFILE_SYSTEM_PROMPT = """You are an expert in Hong Kong travel behavior analysis.
Given a traveler's profile and trip characteristics, predict the most likely main transport mode.

Available modes: 1=Rail, 2=LRT, 3=Tram, 4=Ferry, 5=PLB, 6=Bus, 7=Private Vehicle, 8=Taxi, 9=SPB

You MUST respond in valid JSON with this exact structure:
{"predicted_mode": <integer>, "confidence": <float 0-1>, "reasoning_brief": "<one sentence>"}"""

PROFILE_USER_PROMPT = """Traveler profile:
- Age group: {age_group}
- Sex: {sex}
- Employment status: {employment_status}
- Income level: {income_group}
- Car availability in household: {car_availability}

Trip details:
- Purpose: {trip_purpose}
- Departure period: {departure_period}
- Journey time: {journey_time}

Predict the main transport mode for this trip."""

# Texts of examples and of prototypes inside prompts.
EXAMPLE_TEXT = """  Profile: {age_group} {sex}, {employment_status}, car:{car_availability}
  Trip: {trip_purpose} trip, {departure_period}, ~{journey_time}"""
EXAMPLE_LABEL_TEXT = """
  → Mode: {mode}"""
NO_EXAMPLES_TEXT = "  (none)"
PROTOTYPE_SUMMARY_TEXT = """Behavioral Group {prototype_id}: {label}
  Size: {n} historical travelers
  Mode share (2011): {shares}"""
