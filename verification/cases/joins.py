from pyspark.sql import functions as F

from surveyalign.operators import filters, joins
from surveyalign.plans.survey import harmonized_dataset
from verification import survey_tables as st
from verification.cases import case


@case("filter_valid_records", "SELECT * FROM fx_unified WHERE main_mode >= 1 AND trip_purpose >= 1 AND age_group >= 1")
def _(spark, sf):
    return filters.filter_valid_records(st.unified(spark, sf))


@case("filter_main_modes", "SELECT * FROM fx_tp WHERE mode_raw <= 9")
def _(spark, sf):
    return filters.filter_main_modes(st.trip(spark, sf), "mode_raw")


@case("filter_journey_time", "SELECT * FROM fx_unified WHERE journey_time IS NULL OR journey_time <= 240")
def _(spark, sf):
    return filters.filter_journey_time(st.unified(spark, sf))


@case("apply_all_filters", "SELECT * FROM fx_clean")
def _(spark, sf):
    return filters.apply_all_filters(st.unified(spark, sf))


@case("filter_valid_predictions", """
SELECT survey_year, count(*) AS n_total, count(*) FILTER (WHERE COALESCE(predicted_mode, -1) >= 1) AS n_valid,
       count(*) FILTER (WHERE COALESCE(predicted_mode, -1) < 1) AS n_invalid,
       (SELECT count(*) FROM fx_valid) AS n_kept FROM fx_pred GROUP BY survey_year""")
def _(spark, sf):
    predicted = st.predictions(spark, sf)
    kept = filters.filter_valid_predictions(predicted).agg(F.count(F.lit(1)).alias("n_kept")).scalar()
    return filters.count_predictions(predicted, ["survey_year"]).withColumn("n_kept", kept)


@case("join_trip_member", """
SELECT t.q_no, t.mem, t.trip_no, m.b1, m.b2, m.e_status FROM fx_tp t LEFT JOIN fx_hm m ON t.q_no = m.q_no AND t.mem = m.mem""")
def _(spark, sf):
    return joins.join_trip_member(st.trip(spark, sf), st.member(spark, sf), ["q_no", "mem"]).select(
        "q_no", "mem", "trip_no", "b1", "b2", "e_status")


@case("join_household", """
SELECT t.q_no, t.mem, t.trip_no, h.a3, h.b15, h.c1, h.c2 FROM fx_tp t LEFT JOIN fx_hh h ON t.q_no = h.q_no""")
def _(spark, sf):
    return joins.join_household(st.trip(spark, sf), st.household(spark, sf), "q_no").select(
        "q_no", "mem", "trip_no", "a3", "b15", "c1", "c2")


@case("join_zone_lookup", """
SELECT t.q_no, t.mem, t.trip_no, t.d5, t.d6, o.db26 AS origin_db26, d.db26 AS dest_db26 FROM fx_tp t
LEFT JOIN fx_lookup o ON t.d5 = o.tpusb LEFT JOIN fx_lookup d ON t.d6 = d.tpusb""")
def _(spark, sf):
    lookup = st.lookup(spark, sf).withColumnsRenamed({"tpusb": "11TPUSB", "db26": "DB26"})
    trips = st.trip(spark, sf).withColumnsRenamed({"d5": "D5", "d6": "D6"})
    joined = joins.join_zone_lookup(trips, lookup.unionByName(lookup))
    return joined.select("q_no", "mem", "trip_no", F.col("D5").alias("d5"), F.col("D6").alias("d6"), "origin_db26", "dest_db26")


@case("load_joined_2011", """
SELECT q_no, mem, trip_no, pur, mode_raw, joutm, tiper, deptm, arrtm, d5, d6, wt_trip, b1, b2, e_status, a3, b15,
       car_availability_raw, origin_db26, dest_db26 FROM fx_joined WHERE survey_year = 2011""")
def _(spark, sf):
    joined = joins.load_joined_2011(st.tables_2011(spark, sf))
    names = {"Q_NO": "q_no", "MEM": "mem", "Trip_no": "trip_no", "Pur": "pur", "Mode_Hier": "mode_raw", "Joutm": "joutm",
             "TiPer": "tiper", "Deptm": "deptm", "Arrtm": "arrtm", "D5": "d5", "D6": "d6", "WT_TRIP": "wt_trip",
             "B1": "b1", "B2": "b2", "E_Status": "e_status", "A3": "a3", "B15": "b15"}
    return joined.withColumnsRenamed(names)


@case("load_joined_2022", """
SELECT q_no, mem, trip_no, pur, mode_raw, joutm, tiper, wt_trip, b1, b2, e_status, a3, car_availability_raw,
       origin_db26, dest_db26 FROM fx_joined WHERE survey_year = 2022 AND mode_raw <= 9""")
def _(spark, sf):
    joined = joins.load_joined_2022(st.tables_2022(spark, sf))
    names = {"Q_no": "q_no", "Mem": "mem", "Trip_no": "trip_no", "T_Pur": "pur", "Main_mode": "mode_raw",
             "Journey Time": "joutm", "4_Pks": "tiper", "WT_TRIP": "wt_trip", "B1": "b1", "B2": "b2",
             "E_status": "e_status", "A3": "a3", "O_26PDD": "origin_db26", "D_26PDD": "dest_db26"}
    return joined.drop("D7").withColumnsRenamed(names)


@case("attach_predictions", "SELECT case_id, main_mode, trip_weight, predicted_mode FROM fx_pred")
def _(spark, sf):
    test = st.clean_2022(spark, sf).select("case_id", "main_mode", "trip_weight")
    predicted = st.predictions(spark, sf).select("case_id", "predicted_mode").orderBy(F.desc("case_id"))
    return joins.attach_predictions(test, predicted)


@case("union_years", "SELECT * FROM fx_clean")
def _(spark, sf):
    return harmonized_dataset(st.tables_2011(spark, sf), st.tables_2022(spark, sf))
