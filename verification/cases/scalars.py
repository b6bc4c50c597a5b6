from pyspark.sql import Window
from pyspark.sql import functions as F

from surveyalign.functions import codes as C
from surveyalign.functions import fixed_values as fv
from surveyalign.functions import text as X
from surveyalign.operators import harmonize as H
from surveyalign.operators.inference import build_zero_shot_prompts
from surveyalign.operators.joins import household_attributes, load_joined_2011, load_joined_2022, select_available
from verification import survey_tables as st
from verification.cases import case

TRIP_KEY = "q_no, mem, trip_no"
KEY = ["q_no", "mem", "trip_no"]


@case("select_available", "SELECT q_no, a3, c1 FROM fx_hh")
def _(spark, sf):
    return select_available(st.household(spark, sf), ["q_no", "a3", "no_such_column", "c1"])


@case("map_codes", f"""
SELECT {TRIP_KEY}, survey_year, CASE pur WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 1 ELSE 7 END AS trip_purpose,
       CASE WHEN mode_raw BETWEEN 1 AND 9 THEN mode_raw ELSE -1 END AS main_mode FROM fx_tp""")
def _(spark, sf):
    """Codes arrive as decimals, as they do from a sheet with missing cells."""
    trips = st.trip(spark, sf).withColumns({"pur": F.col("pur").cast("double"), "mode_raw": F.col("mode_raw").cast("string")})
    return trips.select(
        *KEY, "survey_year",
        C.map_codes(C.numeric(trips, "pur"), fv.CROSSWALKS["trip_purpose", 2011], 7).alias("trip_purpose"),
        C.map_codes(C.numeric(trips, "mode_raw"), fv.CROSSWALKS["main_mode", 2011]).alias("main_mode"))


@case("as_id_str", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS STRING) AS price_id,
       CASE WHEN l_partkey % 7 = 0 THEN '-1' ELSE CAST(l_partkey AS STRING) END AS part_id FROM lineitem""")
def _(spark, sf):
    lines = st.table(spark, sf, "lineitem").withColumn(
        "part_text", F.when(F.col("l_partkey") % 7 == 0, F.col("l_returnflag")).otherwise(F.col("l_partkey").cast("string")))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        C.as_id(lines, "l_extendedprice").alias("price_id"), C.as_id(lines, "part_text").alias("part_id"))


@case("age_group", """
SELECT q_no, mem, b2, CASE WHEN b2 IS NULL OR b2 >= 120 THEN -1 WHEN b2 < 15 THEN 1 WHEN b2 < 25 THEN 2
       WHEN b2 < 45 THEN 3 WHEN b2 < 65 THEN 4 ELSE 5 END AS age_group FROM fx_hm""")
def _(spark, sf):
    return st.member(spark, sf).select("q_no", "mem", "b2", C.age_group(F.col("b2")).alias("age_group"))


_HOUR = "(CASE WHEN {0} IS NULL THEN -1.0 ELSE {0} // 100 + ({0} % 100) / 60.0 END)"
_DEP = "(SELECT *, CASE WHEN pk % 11 = 0 THEN NULL ELSE deptm END AS dep FROM fx_tp)"


def _with_missing(spark, sf):
    return st.trip(spark, sf).withColumn("dep", F.when(F.col("pk") % 11 != 0, F.col("deptm")))


@case("hhmm_to_decimal", f"""
SELECT {TRIP_KEY}, round(CAST({_HOUR.format('dep')} AS DOUBLE), 6) AS depart_hour,
       round(CAST({_HOUR.format('arrtm')} AS DOUBLE), 6) AS arrive_hour FROM {_DEP}""")
def _(spark, sf):
    return _with_missing(spark, sf).select(
        *KEY, F.round(C.hhmm_to_decimal(F.col("dep")), 6).alias("depart_hour"),
        F.round(C.hhmm_to_decimal(F.col("arrtm")), 6).alias("arrive_hour"))


@case("journey_minutes", f"""
SELECT {TRIP_KEY}, CASE WHEN dep IS NOT NULL THEN CAST(((arrtm // 100) * 60 + arrtm % 100 - (dep // 100) * 60 - dep % 100 + 1440) % 1440 AS DOUBLE) END AS minutes
FROM {_DEP}""")
def _(spark, sf):
    minutes = C.journey_minutes(F.col("dep"), F.col("arrtm"))
    return _with_missing(spark, sf).select(*KEY, F.round(minutes, 6).alias("minutes"))


_PERIOD = """CASE WHEN {0} >= 7 AND {0} < 9.5 THEN 1 WHEN {0} >= 9.5 AND {0} < 16.5 THEN 2
WHEN {0} >= 16.5 AND {0} < 19 THEN 3 ELSE 4 END"""


@case("departure_period", f"""
SELECT {TRIP_KEY}, CAST({_PERIOD.format(_HOUR.format('dep'))} AS INT) AS from_hhmm,
       CAST(CASE WHEN dep IS NULL THEN -1 ELSE {_PERIOD.format(_HOUR.format('dep'))} END AS INT) AS from_hour FROM {_DEP}""")
def _(spark, sf):
    hour = C.hhmm_to_decimal(F.col("dep"))
    return _with_missing(spark, sf).select(
        *KEY, C.departure_period(hour).alias("from_hhmm"),
        C.departure_period(F.when(F.col("dep").isNotNull(), hour)).alias("from_hour"))


@case("to_numeric_default", """
SELECT q_no, COALESCE(a3, -1) AS hh_size, CASE WHEN q_no % 5 = 0 THEN 1.0 ELSE CAST(b15 AS DOUBLE) END AS weight FROM fx_hh""")
def _(spark, sf):
    df = st.household(spark, sf).withColumn(
        "w", F.when(F.col("q_no") % 5 == 0, "refused").otherwise(F.col("b15").cast("string")))
    return df.select("q_no", C.integer_or(C.numeric(df, "a3"), -1).alias("hh_size"),
                     C.number_or(C.numeric(df, "w"), 1.0).alias("weight"))


@case("car_availability", """
SELECT q_no, CASE WHEN COALESCE(c1,0) + COALESCE(c2,0) <= 0 THEN 0 WHEN COALESCE(c1,0) + COALESCE(c2,0) = 1 THEN 1 ELSE 2 END AS car_availability_raw
FROM fx_hh""")
def _(spark, sf):
    return household_attributes(st.tables_2011(spark, sf)["household"], fv.SURVEY_2011).select(
        F.col("Q_NO").alias("q_no"), "car_availability_raw")


@case("composite_keys", "SELECT case_id, household_id, person_id, trip_no, survey_year FROM fx_unified WHERE survey_year = 2011")
def _(spark, sf):
    trips = st.tables_2011(spark, sf)["trip"]
    return trips.select(*[c.alias(n) for n, c in H.key_columns(trips, fv.SURVEY_2011).items()])


@case("fallback_by_schema", f"""
SELECT case_id, CAST({_PERIOD.format(_HOUR.format('deptm'))} AS INT) AS departure_period
FROM (SELECT *, '2011_' || q_no || '_' || mem || '_' || trip_no AS case_id FROM fx_tp WHERE survey_year = 2011)""")
def _(spark, sf):
    """Without the official period column the period follows from the departure time."""
    trips = st.tables_2011(spark, sf)["trip"].drop("TiPer")
    keys = H.key_columns(trips, fv.SURVEY_2011)
    return trips.select(keys["case_id"].alias("case_id"), H.period_or_derived(trips, fv.SURVEY_2011, hhmm=True).alias("departure_period"))


@case("fallback_by_data", f"""
SELECT {TRIP_KEY}, joutm AS kept,
       CAST(((arrtm // 100) * 60 + arrtm % 100 - (deptm // 100) * 60 - deptm % 100 + 1440) % 1440 AS DOUBLE) AS derived FROM fx_tp""")
def _(spark, sf):
    """A column with values keeps its nulls; one that is null throughout is replaced."""
    trips = st.trip(spark, sf).withColumn("empty", F.lit(None).cast("double"))
    return trips.select(*KEY, H.journey_or_elapsed(trips, "joutm", "deptm", "arrtm").alias("kept"),
                        F.round(H.journey_or_elapsed(trips, "empty", "deptm", "arrtm"), 6).alias("derived"))


_AGE = "CASE age_group WHEN 1 THEN '0-14' WHEN 2 THEN '15-24' WHEN 3 THEN '25-44' WHEN 4 THEN '45-64' WHEN 5 THEN '65+' ELSE 'Unknown' END"
_SEX = "CASE sex WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' ELSE 'Unknown' END"
_EMP = "CASE employment_status WHEN 1 THEN 'Full-time' WHEN 2 THEN 'Part-time' WHEN 3 THEN 'Self-emp' WHEN 4 THEN 'Student' WHEN 5 THEN 'Homemaker' WHEN 6 THEN 'Retired' WHEN 7 THEN 'Other' ELSE 'Unknown' END"
_INC = "CASE income_group WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Low' WHEN 2 THEN 'Lower-mid' WHEN 3 THEN 'Middle' WHEN 4 THEN 'Upper-mid' WHEN 5 THEN 'High' ELSE 'Unknown' END"
_CAR = "CASE car_availability WHEN 0 THEN 'No car' WHEN 1 THEN '1 car' WHEN 2 THEN '2+ cars' ELSE 'Unknown' END"
_PUR = "CASE trip_purpose WHEN 1 THEN 'Work' WHEN 2 THEN 'Education' WHEN 7 THEN 'Other' ELSE 'Unknown' END"
_PER = "CASE departure_period WHEN 1 THEN 'AM Peak' WHEN 2 THEN 'Inter-peak' WHEN 3 THEN 'PM Peak' WHEN 4 THEN 'Off-peak' ELSE 'Unknown' END"
_JRN = "CASE WHEN journey_time > 0 THEN CAST(CAST(trunc(journey_time) AS BIGINT) AS STRING) || ' minutes' ELSE 'unknown' END"
_MODE = "COALESCE((SELECT mode_label FROM fx_modes WHERE mode = main_mode), 'Unknown')"
_CONTEXT = f"""case_id, survey_year, {_AGE} AS age_group, {_SEX} AS sex, {_EMP} AS employment_status, {_INC} AS income_group,
 CAST(hh_size AS STRING) AS hh_size, {_CAR} AS car_availability, {_PUR} AS trip_purpose, {_PER} AS departure_period,
 {_JRN} AS journey_time, origin_zone, destination_zone"""


def _flat(name):
    c = F.col(name)
    return [c["case_id"].alias("case_id"), c["survey_year"].alias("survey_year"),
            *[c["person"][f].alias(f) for f in ("age_group", "sex", "employment_status", "income_group")],
            *[c["household"][f].alias(f) for f in ("hh_size", "car_availability")],
            *[c["trip"][f].alias(f) for f in ("trip_purpose", "departure_period", "journey_time", "origin_zone", "destination_zone")]]


@case("decode_labels", f"SELECT case_id, {_AGE} AS age_label, {_EMP} AS employment_label, {_PER} AS period_label FROM fx_unified")
def _(spark, sf):
    return st.unified(spark, sf).select(
        "case_id", C.decode(F.col("age_group"), fv.AGE_LABELS).alias("age_label"),
        C.decode(F.col("employment_status"), fv.EMPLOYMENT_LABELS).alias("employment_label"),
        C.decode(F.col("departure_period"), fv.PERIOD_LABELS).alias("period_label"))


@case("record_to_context", f"SELECT {_CONTEXT} FROM fx_unified")
def _(spark, sf):
    return st.unified(spark, sf).select(X.context().alias("c")).select(*_flat("c"))


@case("to_demonstration", f"SELECT {_CONTEXT}, main_mode, {_MODE} AS main_mode_label FROM fx_unified")
def _(spark, sf):
    demo = st.unified(spark, sf).select(X.demonstration().alias("c"))
    return demo.select(*_flat("c"), F.col("c")["label"]["main_mode"].alias("main_mode"),
                       F.col("c")["label"]["main_mode_label"].alias("main_mode_label"))


_EXAMPLE = (f"'  Profile: ' || {_AGE} || ' ' || {_SEX} || ', ' || {_EMP} || ', car:' || {_CAR} || chr(10) || '  Trip: ' || {_PUR} || ' trip, ' "
            f"|| {_PER} || ', ~' || {_JRN} || chr(10) || '  → Mode: ' || {_MODE}")


_DEMONSTRATED = ["case_id", "survey_year", "age_group", "sex", "employment_status", "income_group", "hh_size", "car_availability",
                 "trip_purpose", "departure_period", "journey_time", "origin_zone", "destination_zone", "main_mode"]


@case("render_examples", f"""
SELECT person_id, COALESCE(string_agg(CASE WHEN n <= 4 THEN 'Example ' || CAST(n AS STRING) || ':' || chr(10) || txt END, chr(10) ORDER BY n), '  (none)') AS text
FROM (SELECT person_id, ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY trip_no, case_id) AS n, {_EXAMPLE} AS txt FROM fx_clean)
GROUP BY person_id""")
def _(spark, sf):
    """The first trips of each person as examples; the others are dropped before the shuffle."""
    first = Window.partitionBy("person_id").orderBy("trip_no", "case_id")
    trips = st.clean(spark, sf).withColumn("n", F.row_number().over(first)).where("n <= 4")
    # Codes are grouped, not their labels: what a demonstration adds is text, and longer.
    record = F.struct(*_DEMONSTRATED).alias("record")
    lists = trips.groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("n", record))).alias("ds"))
    return lists.select("person_id", X.examples_text(F.transform("ds", lambda d: X.demonstration(d["record"])), 4).alias("text"))


@case("build_zero_shot_prompts", f"""
SELECT case_id, 'Traveler profile:' || chr(10) || '- Age group: ' || {_AGE} || chr(10) || '- Sex: ' || {_SEX} || chr(10)
 || '- Employment status: ' || {_EMP} || chr(10) || '- Income level: ' || {_INC} || chr(10)
 || '- Car availability in household: ' || {_CAR} || chr(10) || chr(10) || 'Trip details:' || chr(10) || '- Purpose: ' || {_PUR} || chr(10)
 || '- Departure period: ' || {_PER} || chr(10) || '- Journey time: ' || {_JRN} || chr(10) || chr(10)
 || 'Predict the main transport mode for this trip.' AS user_prompt, 'system' AS first_role
FROM fx_clean WHERE survey_year = 2022""")
def _(spark, sf):
    prompts = build_zero_shot_prompts(st.clean_2022(spark, sf))
    return prompts.select("case_id", F.col("messages")[1]["content"].alias("user_prompt"), F.col("messages")[0]["role"].alias("first_role"))


@case("zone_int", "SELECT case_id, CAST(origin_zone AS INT) AS origin_zone_int, CAST(destination_zone AS INT) AS dest_zone_int FROM fx_unified")
def _(spark, sf):
    return st.unified(spark, sf).select("case_id", C.zone_int(F.col("origin_zone")).alias("origin_zone_int"),
                                        C.zone_int(F.col("destination_zone")).alias("dest_zone_int"))


@case("conform_schema", """
SELECT case_id, household_id, person_id, trip_no, survey_year, hh_size, car_availability, age_group, sex, employment_status,
       income_group, CAST(NULL AS INT) AS trip_purpose, departure_period, journey_time, origin_zone, destination_zone, main_mode,
       CAST(NULL AS DOUBLE) AS trip_weight, raw_mode_2011, raw_purpose_2011 FROM fx_unified""")
def _(spark, sf):
    shuffled = st.unified(spark, sf).drop("trip_purpose", "trip_weight").select(*sorted(
        c for c in fv.CANONICAL_COLUMNS if c not in ("trip_purpose", "trip_weight")))
    return H.conform_schema(shuffled)


@case("harmonize_2011", "SELECT * FROM fx_unified WHERE survey_year = 2011")
def _(spark, sf):
    return H.harmonize_2011(load_joined_2011(st.tables_2011(spark, sf)))


@case("harmonize_2022", "SELECT * FROM fx_unified WHERE survey_year = 2022")
def _(spark, sf):
    return H.harmonize_2022(load_joined_2022(st.tables_2022(spark, sf), max_mode=None))
