import datetime as dt
import json
from decimal import Decimal
from types import SimpleNamespace

import __spark_entry__ as entry
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from harborline.functions.names import padded_id, schema_name, stamped_id
from harborline.functions.numeric import row_total
from harborline.functions.text import strip_code_fences, thousands, words
from harborline.operators import trees
from harborline.operators.quality import dq_suite, staging_rules
from harborline.plans import actions, anomalies, features, marts, models, questions, starter, summaries
from harborline.plans.warehouse import RawTables, Warehouse
from harborline.schemas import BOOKINGS, RAW_TABLES
from harborline.sources import sinks, tables
from harborline.sources.durable import stored
from harborline.streaming.decisions import log_decisions, read_decisions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    assert one(spark, padded_id("BK", F.lit(42), 7)) == "BK0000042"
    assert one(spark, padded_id("BK", F.lit(123456789), 7)) == "BK123456789"
    assert schema_name(None, "main") == "main" and schema_name(" marts ", "main") == "MARTS"
    run = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    a, b = (one(spark, stamped_id("ACT_", run, [F.lit(k)])) for k in ("a", "b"))
    assert a.startswith("ACT_20240506070809_") and a != b


def test_text(spark):
    assert one(spark, thousands(F.lit(1234567.8))) == "1,234,567.80"
    assert one(spark, thousands(F.lit(None).cast("double"))) == "nan"
    assert one(spark, words(F.lit("Añb 12-c"))) == ["añb", "12", "c"]
    assert one(spark, strip_code_fences(F.lit("```sql\nSELECT 1\n```"))) == "SELECT 1"
    assert one(spark, row_total([F.lit(Decimal("1.10")), F.lit(Decimal("2.25"))])) == Decimal("3.35")


def test_replies(spark):
    rows = [
        ("ANSWERABLE: Yes\nREASON: fine \nSUGGESTION: none",),
        ("ANSWERABLE: no\nREASON: outside",),
    ]
    got = questions.parse_validation(spark.createDataFrame(rows, "reply string"), "reply").collect()
    assert (got[0].answerable, got[0].reason, got[0].suggestion) == (True, "fine", "none")
    assert (got[1].answerable, got[1].reason) == (False, questions.DEFAULT_REASON)


def test_result_lines(spark):
    df = spark.createDataFrame([("a", 1.5, None), ("b", 12345678.904, True)], "k string, v double, f boolean")
    got = [r.line for r in questions.result_lines(df, [F.asc("k")]).orderBy("line_no").collect()]
    assert got == ["k | v | f", "-" * 60, "a | 1.5 | None", "b | 12345678.9 | True"]
    many = spark.range(30)
    assert questions.result_lines(many, [F.asc("id")]).count() == 22
    empty = questions.result_lines(df.limit(0), [F.asc("k")]).collect()
    assert [r.line for r in empty] == ["Query returned no results."]


def test_starter_models(spark):
    first = starter.first_model(spark)
    assert sorted((r.id for r in first.collect()), key=str) == [1, None]
    assert [r.id for r in starter.second_model(first).collect()] == [1]


def test_csv_round_trip_keeps_the_tier_named_none(spark, make_bookings, tmp_path):
    bookings = make_bookings({"loyalty_tier": "None"}, {"booking_id": "B", "cancellation_reason": "Work"})
    path = str(tmp_path / "bookings")
    sinks.write_csv(bookings, path)
    loaded = tables.load_tables(spark, {"STG_BOOKINGS": path})["STG_BOOKINGS"]
    assert sorted(loaded.collect(), key=str) == sorted(bookings.collect(), key=str)
    assert spark.table("STG_BOOKINGS").schema == BOOKINGS
    assert tables.upper_names(loaded).columns[0] == "BOOKING_ID"


def test_csv_cells_keep_line_breaks(spark, tmp_path):
    texts = ['two\nlines', 'a "quoted"\n\n"cell"', " led, and trailed ", "x\r\ny", "back\\slash\\", None, "tab\t", "#no comment"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    path = str(tmp_path / "texts")
    sinks.write_csv(frame, path, rows_per_file=3)
    assert len(list((tmp_path / "texts").glob("*.csv"))) == 3
    back = tables.read_csv(spark, path, frame.schema)
    assert sorted(map(tuple, back.collect())) == list(enumerate(texts))


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "spend.csv"
    path.write_text(
        "DINING,SPA,EXCURSIONS,BEVERAGE,CASINO,RETAIL,BOOKING_ID,GUEST_ID,BRAND,SAIL_DATE,"
        "TOTAL_ONBOARD_SPEND_USD,_FIVETRAN_SYNCED\n"
        "1.5,2,0,0.0,3.25,,BK0000001,G0000001,Regent,2024-07-05,6.75,2024-01-02T03:04:05.678901\n"
    )
    row = tables.read_csv(spark, str(path), RAW_TABLES["stg_onboard_spend"]).first()
    assert (row.booking_id, row.dining, row.retail) == ("BK0000001", Decimal("1.50"), None)
    assert row.sail_date == dt.date(2024, 7, 5)
    assert row._fivetran_synced == dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(path), RAW_TABLES["stg_guests"])


def test_tables(spark, make_bookings, tmp_path):
    bookings = make_bookings({}, {"booking_id": "B"}, {"booking_id": "C"})
    name = sinks.save_table(bookings, "t_bookings", schema=" stage ")
    assert name == "`STAGE`.`t_bookings`"
    shuffled = bookings.limit(2).select(*reversed(bookings.columns))
    assert sinks.overwrite_table(shuffled, "stage.t_bookings") == 2
    assert tables.source(spark, "stage", "t_bookings").select("booking_id").distinct().count() == 2
    with pytest.raises(ValueError):
        sinks.overwrite_table(bookings.drop("brand"), "stage.t_bookings")
    spark.sql("DROP TABLE stage.t_bookings")


def _raw(make_bookings, make_spend, make_guests, make_pricing):
    rows = []
    for i in range(60):
        rows.append(
            {
                "booking_id": f"BK{i:04d}",
                "guest_id": f"G{i % 17}",
                "brand": ["Norwegian", "Oceania", "Regent"][i % 3],
                "region": ["Alaska", "Asia"][i % 2],
                "itinerary_name": ["Alaska Explorer", "Asia Discovery"][i % 2],
                "cabin_category": ["Inside", "Veranda", "Master Suite"][i % 3],
                "is_cancelled": i % 4 == 0,
                "cabin_price_usd": Decimal(900 + 7 * i),
                "total_revenue_usd": Decimal(1800 + 14 * i),
                "sail_date": dt.date(2024, 1 + i % 12, 5),
            }
        )
    spend = [
        {"booking_id": r["booking_id"], "total_onboard_spend_usd": Decimal(10 * i)}
        for i, r in enumerate(rows)
        if not r["is_cancelled"]
    ]
    pricing = [
        {
            "price_log_id": f"PL{i}",
            **{k: rows[i][k] for k in ("brand", "region", "itinerary_name", "cabin_category", "sail_date")},
        }
        for i in range(60)
    ]
    guests = [{"guest_id": f"G{i}"} for i in range(17)]
    return RawTables(
        make_bookings(*rows), make_guests(*guests), make_spend(*spend), make_pricing(*pricing)
    )


@pytest.fixture
def warehouse(make_bookings, make_spend, make_guests, make_pricing):
    return Warehouse(_raw(make_bookings, make_spend, make_guests, make_pricing))


def test_quality_of_clean_data(warehouse):
    assert all(r.failures == 0 for r in warehouse.quality().collect())
    assert warehouse.quality().count() == len(staging_rules())


def test_duplicate_spend_is_reported(warehouse, make_spend):
    spend = make_spend({}, {})
    got = dq_suite({"stg_onboard_spend": spend}, staging_rules()).where("test = 'unique'").first()
    assert got.failures == 1


def test_documents_and_index(spark, warehouse, tmp_path):
    docs = warehouse.documents
    rows = sorted(docs.collect(), key=lambda r: int(r.doc_id[4:]))
    assert [r.doc_id for r in rows] == [f"doc_{i}" for i in range(len(rows))]
    assert [r.type for r in rows] == sorted(
        (r.type for r in rows), key=["occupancy", "revenue", "pricing", "aggregate"].index
    )
    assert rows[-1].brand == "all"
    groups = (
        summaries.occupancy_quarterly(warehouse.mart_occupancy).count()
        + summaries.revenue_quarterly(warehouse.mart_revenue).count()
        + summaries.pricing_quarterly(warehouse.mart_pricing_summary).count()
    )
    assert len(rows) == groups + 3 + 1
    path = str(tmp_path / "index")
    sinks.write_index(docs, path)
    sinks.write_index(docs, path)
    back = sinks.read_index(spark, path)
    assert back.count() == len(rows) and set(back.columns) == set(docs.columns)


def test_anomaly_filter_runs_after_the_limit(make_bookings):
    rows = [
        {"booking_id": str(i), "region": f"R{i}", "is_cancelled": i < 3} for i in range(30)
    ]
    occupancy = marts.mart_occupancy(make_bookings(*rows))
    assert anomalies.anomalies(occupancy).count() == 3
    assert anomalies.anomalies(occupancy, scan_limit=2).count() == 2
    assert anomalies.anomalies(occupancy, min_occupancy=101.0).count() == 20
    assert anomalies.anomalies(occupancy, min_occupancy=101.0, scan_limit=None).count() == 30


def test_actions_decisions_and_stream(spark, make_bookings, tmp_path):
    rows = [{"booking_id": str(i), "region": f"R{i}", "is_cancelled": True} for i in range(3)]
    found = anomalies.anomalies(marts.mart_occupancy(make_bookings(*rows)))
    run = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert actions.propose_actions(found, run).count() == actions.ACT_ON
    proposed = actions.propose_actions(found, run, top=None)
    ids = sorted(r.action_id for r in proposed.collect())
    answers = spark.createDataFrame([(ids[0], " Yes "), (ids[1], "maybe")], "action_id string, answer string")
    status = {r.action_id: r.status for r in actions.decide(proposed, answers).collect()}
    assert [status[i] for i in ids] == ["APPROVED", "REJECTED", "PENDING_APPROVAL"]
    assert {r.status for r in actions.decide(proposed, auto_approve=True).collect()} == {"APPROVED"}

    log, inbox = str(tmp_path / "log"), tmp_path / "inbox"
    inbox.mkdir()
    sinks.append_log(actions.log_events(proposed, run), str(tmp_path / "proposed"))
    for n, (action, answer) in enumerate([(ids[0], "no"), (ids[0], "yes"), ("unknown", "yes")]):
        row = {"action_id": action, "answer": answer, "decided_at": f"2024-01-0{n + 2}T00:00:00"}
        (inbox / f"{n}.json").write_text(json.dumps(row))

    def take_in():
        stream = read_decisions(spark, str(inbox))
        log_decisions(stream, proposed, log, str(tmp_path / "offsets")).awaitTermination(120)
        return sorted(sinks.read_log(spark, log).collect())

    first = take_in()
    assert len(first) == 2
    assert take_in() == first  # nothing new
    (inbox / "again.json").write_text((inbox / "0.json").read_text())
    assert take_in() == first  # a decision delivered again
    last = max(int(f.name) for f in (tmp_path / "offsets" / "commits").iterdir() if f.name.isdigit())
    for f in (str(last), f".{last}.crc"):
        (tmp_path / "offsets" / "commits" / f).unlink(missing_ok=True)
    assert take_in() == first  # a batch whose end was not recorded runs again
    logged = sinks.read_log(spark, log)
    events = sinks.read_log(spark, str(tmp_path / "proposed")).unionByName(logged)
    now = {r.action_id: r.status for r in actions.current_status(events).collect()}
    assert [now[i] for i in ids] == ["APPROVED", "PENDING_APPROVAL", "PENDING_APPROVAL"]


def test_feature_frame_grain(warehouse):
    frame = features.feature_frame(warehouse.mart_revenue, warehouse.mart_guest_ltv)
    assert frame.count() == 60 and len(frame.columns) == 36
    assert set(features.FEATURES) <= set(frame.columns)
    fanned = features.feature_frame(warehouse.mart_revenue, warehouse.mart_guest_ltv, by_brand=False)
    assert fanned.count() > 60


def test_training_logs_and_saves(spark, warehouse, tmp_path):
    frame = features.feature_frame(warehouse.mart_revenue, warehouse.mart_guest_ltv)
    for name, expected in (
        ("cancellation_risk", {"accuracy", "auc_roc"}),
        ("revenue_per_night", {"mae", "r2"}),
    ):
        trained = models.train(frame, models.SPECS[name], ["booking_id"], trees=2)
        log = {r.key: r.value for r in trained.run_log.collect()}
        assert expected | {"train_rows", "test_rows", "trees"} <= set(log)
        assert models.top_features(trained).count() == 5
        rows = 60 if name == "cancellation_risk" else 45
        assert log["train_rows"] + log["test_rows"] == rows
    path = str(tmp_path / "model")
    models.save_model(trained, path)
    assert len(PipelineModel.load(path).stages) == 2
    agreed = models.compare_with_nodes(trained, ["booking_id"], path).first()
    assert agreed.test_rows == agreed.same_scores > 0 and agreed.same_importances == len(features.FEATURES)
    nulls = frame.limit(1).select(*[F.lit(None).cast("double").alias(c) for c in features.FEATURES])
    assert models.score_saved(nulls, path).select("score").first()[0] is not None
    sinks.append_log(trained.run_log, str(tmp_path / "runs"))
    sinks.append_log(trained.run_log, str(tmp_path / "runs"))
    assert sinks.read_log(spark, str(tmp_path / "runs")).count() == 2 * trained.run_log.count()


def test_parts_of_a_fit_follow_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    files = stored(spark.range(4000).repartition(30, "id"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "4k")
    try:
        parts = models.in_parts(files, 4000).rdd.glom().collect()
        assert files.rdd.getNumPartitions() > cores == len(parts)
        assert parts == models.in_parts(files, 4000).rdd.glom().collect()
        assert sorted(r.id for p in parts for r in p) == list(range(4000))
        more = models.in_parts(files, cores * models.PART_ROWS + 1)
        assert more.rdd.getNumPartitions() == 2 * cores
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_parts_of_a_fit_are_equal_however_unequal_the_files(spark):
    cores = spark.sparkContext.defaultParallelism
    piles = spark.range(8000).repartition(3, F.when(F.col("id") < 7000, 0).otherwise(F.col("id")))
    files = stored(piles.withColumn("label", F.when(F.col("id") % 7 > 0, 1.0)))
    dealt = models.in_parts(files, 8000)
    parts = [[r.id for r in p] for p in dealt.rdd.glom().collect()]
    assert len(parts) == cores
    assert max(map(len, parts)) - min(map(len, parts)) <= files.rdd.getNumPartitions()
    assert all(p == sorted(p) for p in parts)
    assert sorted(i for p in parts for i in p) == list(range(8000))


def test_nodes_are_walked_in_batches(spark):
    schema = "tree int, node int, feature int, threshold double, left int, right int, value double, gain double, weight double, n_rows double"
    nodes = [
        (0, 0, 0, 1.0, 1, 2, 9.0, 1.0, 1.0, 4.0),
        (0, 1, None, None, None, None, 1.0, None, 1.0, 2.0),
        (0, 2, 1, 0.0, 3, 4, 9.0, 1.0, 1.0, 2.0),
        (0, 3, None, None, None, None, 2.0, None, 1.0, 1.0),
        (0, 4, None, None, None, None, 3.0, None, 1.0, 1.0),
        (1, 0, None, None, None, None, 4.0, None, 0.5, 4.0),
    ]
    saved = trees.SavedTrees(spark.createDataFrame(nodes, schema), False, 2)
    nan = float("nan")
    rows = [(0, 1.0, 5.0), (1, 1.5, 0.0), (2, 1.5, 0.5), (3, None, None), (4, nan, None), (5, nan, nan)]
    scored = trees.score_rows(spark.createDataFrame(rows, "id int, a double, b double"), saved, ["a", "b"])
    assert {r.id: r.score for r in scored.collect()} == {0: 3.0, 1: 4.0, 2: 5.0, 3: 3.0, 4: 4.0, 5: 5.0}
    assert "ArrowEvalPython" in scored._jdf.queryExecution().executedPlan().toString()


def test_models_share_one_frame(spark, monkeypatch):
    asked, marker = [], spark.range(3)
    monkeypatch.setattr(entry, "_FRAMES", {})
    monkeypatch.setattr(entry, "_TRAINED", {})
    monkeypatch.setattr(entry.features, "feature_frame", lambda *a, **k: asked.append(1) or marker)
    monkeypatch.setattr(entry.models, "train", lambda frame, spec, keys: (spec.run, frame.count()))
    star = SimpleNamespace(spark=spark, folder="none")
    names = ["mart_revenue", "mart_guest_ltv", "stg_bookings"]
    wh = SimpleNamespace(staged=lambda *a: SimpleNamespace(**dict.fromkeys(names)))
    assert entry._train_all(star, wh) == [(name, 3) for name in models.SPECS]
    assert entry._train("upsell_propensity")(star, wh) == ("upsell_propensity", 3) and len(asked) == 1


def test_free_sql_and_views(spark, warehouse):
    questions.register_marts(warehouse.marts())
    got = questions.run_sql(spark, "```sql\nSELECT COUNT(*) AS n FROM mart_revenue\n```").first()
    assert got.n == 60
    assert set(RAW_TABLES) == {"stg_bookings", "stg_guests", "stg_onboard_spend", "stg_pricing_log"}


def test_standing_questions_have_answers(warehouse):
    for question in questions.STANDING_QUESTIONS:
        answered = questions.answer(question, warehouse.marts())
        assert answered.columns and answered.count() >= 0
    best = questions.answer("Which region is doing well?", warehouse.marts()).first()
    assert best.region == "Alaska" or best.region == "Asia"


def test_transcript(spark):
    rows = [("How?", "So.", "SELECT 1", "x")]
    answers = spark.createDataFrame(rows, "question string, answer string, sql string, results string")
    got = [tuple(r) for r in questions.transcript(answers).collect()]
    assert got == [("user", "How?", None, None), ("assistant", "So.", "SELECT 1", "x")]


def test_unanswered_questions_stay_in_the_transcript(spark):
    rows = [("How?", None, None, None)]
    answers = spark.createDataFrame(rows, "question string, answer string, sql string, results string")
    assert [tuple(r) for r in questions.transcript(answers).collect()] == [("user", "How?", None, None)]


def test_csv_quotes_are_doubled(spark, make_guests, tmp_path):
    guests = make_guests({"first_name": 'say "hi", Bob', "last_name": "back\\slash"})
    sinks.write_csv(guests, str(tmp_path / "guests"))
    text = "".join(p.read_text() for p in (tmp_path / "guests").glob("part-*"))
    assert '"say ""hi"", Bob"' in text
    row = tables.read_csv(spark, str(tmp_path / "guests"), RAW_TABLES["stg_guests"]).first()
    assert (row.first_name, row.last_name) == ('say "hi", Bob', "back\\slash")


@pytest.mark.parametrize("line", ["G1,Ann", "G1,Ann,Lee,a@b.c,UK,25-34,Regent,1,Gold,2024-01-01T00:00:00,extra"])
def test_csv_rows_of_another_length_are_errors(spark, tmp_path, line):
    names = ",".join(f.name for f in RAW_TABLES["stg_guests"])
    (tmp_path / "guests.csv").write_text(f"{names}\n{line}\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_csv(spark, str(tmp_path / "guests.csv"), RAW_TABLES["stg_guests"]).select("guest_id").collect()


def test_status_of_two_events_at_one_instant(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("A", "b", "i", "APPROVED", at), ("A", "b", "i", "PENDING_APPROVAL", at)]
    schema = "action_id string, brand string, itinerary string, status string, at timestamp_ntz"
    for order in (rows, rows[::-1]):
        got = actions.current_status(spark.createDataFrame(order, schema)).first()
        assert got.status == "APPROVED"


def test_free_sql_leaves_no_view(spark):
    got = questions.run_sql(spark, "SELECT sum(id) AS s FROM numbers_mart", {"numbers_mart": spark.range(4)})
    assert got.first().s == 6
    assert not spark.catalog.tableExists("numbers_mart")


def test_refusal_of_a_question_outside_the_data(spark):
    rows = [("ANSWERABLE: no\nREASON: No weather data.\nSUGGESTION: revenue by region",), ("ANSWERABLE: yes",)]
    parsed = questions.parse_validation(spark.createDataFrame(rows, "reply string"), "reply")
    got = [r.refusal for r in questions.refusals(parsed).collect()]
    assert got == [
        "I can't answer that with the available data. No weather data. Try asking: 'revenue by region'", None
    ]
