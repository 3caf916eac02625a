"""Sources, sinks and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rolescope.operators import merge
from rolescope.rules import Rules
from rolescope.schemas import SCRAPED_HEADER
from rolescope.sources import readers, writers
from rolescope.sources.json_values import ARRAY, MAP, members
from rolescope.streaming.changes import stream_changes
from rolescope.streaming.imports import compact, merge_batch, read_catalog, stream_import

HEADER = "Job Title,Company,Location,Work Type,Salary,Posted Date,Applicants,Description,Application Link,Job Link,Search Location"


def test_csv_with_bom_quotes_and_line_ends(spark, tmp_path):
    line = '"Dev ""A""",Acme,Oslo,,"$1,000",,,"one\ntwo, ""three""",u,https://x/view/1,Oslo'
    (tmp_path / "a.csv").write_text("﻿" + HEADER + "\n" + line + "\n", encoding="utf-8")
    row = readers.read_postings(spark, str(tmp_path)).first()
    assert (row.title, row.salary, row.description, row.work_type) == ('Dev "A"', "$1,000", 'one\ntwo, "three"', None)
    assert row.search_location == "Oslo" and row.source_file.endswith("a.csv")


def test_scraped_layout_binds_by_name(spark, tmp_path):
    jobs = spark.createDataFrame([("Dev", "Acme", "Oslo", 'a "b"\nc', "u", "v")],
                                 "title string, company string, location string, description string, apply_link string, job_link string")
    writers.write_postings(jobs, str(tmp_path / "out"))
    row = readers.read_postings(spark, str(tmp_path / "out")).first()
    assert (row.title, row.company, row.description, row.apply_link, row.job_link) == ("Dev", "Acme", 'a "b" c', "u", "v")
    files = list((tmp_path / "out").glob("*.csv"))
    assert files[0].read_text().splitlines()[0].replace('"', "") == ",".join(SCRAPED_HEADER)


def test_legacy_json(spark, tmp_path):
    (tmp_path / "jobs.json").write_text(json.dumps([{"id": "a", "title": "T", "score": 3}, {"title": "no id"}, {"id": "a", "title": "U"}]))
    (tmp_path / "state.json").write_text(json.dumps({"a": {"status": "Applied", "timestamps": {"Applied": "1"}}, "b": {}}))
    (tmp_path / "plans.json").write_text(json.dumps([{"id": "p", "title": "P", "jobs": [{"id": "a"}, {"id": "z"}, {"id": "a", "notes": "x"}]}]))
    (tmp_path / "cache.json").write_text(json.dumps({"Acme": {"summary": "s"}}))
    jobs = readers.read_job_array(spark, str(tmp_path / "jobs.json"))
    table, counts = merge.migrate_jobs(jobs, spark.createDataFrame([("q", "Q")], "id string, title string"))
    assert sorted((row.id, row.title) for row in table.collect()) == [("a", "T"), ("q", "Q")]
    assert tuple(counts.first()) == (2, 1, 1)
    states = merge.migrate_states(jobs, readers.read_state_map(spark, str(tmp_path / "state.json")))
    assert [(row.job_id, row.status, row.timestamps) for row in states.collect()] == [("a", "Applied", {"Applied": "1"})]
    plans, members = readers.read_plan_array(spark, str(tmp_path / "plans.json"))
    _, kept = merge.replace_plans(plans, members, table)
    assert [(row.job_id, row.notes) for row in kept.collect()] == [("a", "")]
    company = readers.read_company_map(spark, str(tmp_path / "cache.json")).first()
    assert (company.company_name, company.summary, company.industry) == ("Acme", "s", None)


@pytest.fixture
def split_size(spark):
    names = ("maxPartitionBytes", "openCostInBytes", "minPartitionNum")

    def use(size):
        for name, value in zip(names, (size, 0, 500)):
            spark.conf.set(f"spark.sql.files.{name}", value)
    yield use
    for name in names:
        spark.conf.unset(f"spark.sql.files.{name}")


def odd_text(random):
    return "".join(random.choice('ab{}"\\,:[] \n}é') for _ in range(random.randint(0, 30)))


@pytest.mark.parametrize("size", [1 << 27, 300, 41])
@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_json_files_are_cut_at_any_byte(spark, tmp_path, split_size, size, style):
    source = random.Random(size)
    split_size(size)
    states = {f"k{n}{odd_text(source)}": {"status": odd_text(source), "timestamps": {odd_text(source): odd_text(source)}, "more": {}}
              for n in range(60)}
    states["none"] = None
    (tmp_path / "a.json").write_text(json.dumps(states, **style) + "\n", encoding="utf-8")
    rows = members(spark, str(tmp_path / "a.json"), MAP).collect()
    assert sorted(row.number for row in rows) == list(range(61))
    found = {}
    for row in sorted(rows, key=lambda row: row.number):
        found.update(json.loads("{" + row.text + "}"))
    assert list(found.items()) == list(states.items())
    jobs = [value for value in states.values() if value]
    (tmp_path / "b.json").write_text(" " + json.dumps(jobs, **style) + "\n\n", encoding="utf-8")
    rows = members(spark, str(tmp_path / "b.json"), ARRAY).collect()
    assert [json.loads(row.text) for row in sorted(rows, key=lambda row: row.number)] == jobs


def test_one_map_is_read_by_many_tasks(spark, tmp_path, split_size):
    split_size(2000)
    (tmp_path / "s.json").write_text(json.dumps({f"j{n}": {"status": "Applied", "notes": "}{" * 20} for n in range(300)}))
    pieces = spark.read.option("lineSep", "}").text(str(tmp_path / "s.json"))
    assert pieces.select(F.spark_partition_id()).distinct().count() > 5
    states = readers.read_state_map(spark, str(tmp_path / "s.json"))
    assert sorted(row.job_id for row in states.collect()) == sorted(f"j{n}" for n in range(300))


def spilled(plan):
    """Bytes that the plan's windows moved to disk, each."""
    found = [plan.metrics().apply("spillSize").value()] if plan.nodeName() == "Window" else []
    children = plan.children()
    return sum((spilled(children.apply(at)) for at in range(children.size())), found)


def test_windows_hold_few_pieces_of_a_byte_range(spark, tmp_path):
    source = random.Random(7)
    states = {f"k{n}{odd_text(source)}": {"status": odd_text(source), "more": {odd_text(source): {}}} for n in range(3000)}
    # Blocks that lie within one string, and within one member.
    states["text"] = {"notes": "}{" * 5000 + '"', "status": "S"}
    states["deep"] = {"list": [{"n": n, "text": "}"} for n in range(4000)]}
    states["last"] = {"status": "T"}
    (tmp_path / "a.json").write_text(json.dumps(states), encoding="utf-8")
    jobs = list(states.values())
    (tmp_path / "b.json").write_text(json.dumps(jobs, indent=1), encoding="utf-8")
    # Without adaptive plans a plan has its figures in place; a group beyond this many rows goes to disk.
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.windowExec.buffer.spill.threshold": "4096"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for file, between, ends, whole in (("a", MAP, "{}", list(states.items())), ("b", ARRAY, "[]", jobs)):
            pieces = spark.read.option("lineSep", "}").text(str(tmp_path / f"{file}.json"))
            assert pieces.rdd.getNumPartitions() == 1 and pieces.count() > 20000
            cut = members(spark, str(tmp_path / f"{file}.json"), between)
            rows = sorted(cut.collect(), key=lambda row: row.number)
            assert [row.number for row in rows] == list(range(3003))
            found = json.loads(ends[0] + ",".join(row.text for row in rows) + ends[1])
            assert (list(found.items()) if between == MAP else found) == whole
            moved = spilled(cut._jdf.queryExecution().executedPlan())
            assert moved and not any(moved)
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_odd_json_files(spark, tmp_path):
    for name, text in {"a": "{}", "b": "", "c": " { } \n", "d": '\ufeff{"x": {"status": "S"}}\n'}.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    (tmp_path / "cut.json").write_text('{"y": {"status": "T"}, "z": {"status": "half', encoding="utf-8")
    assert sorted((row.job_id, row.status) for row in readers.read_state_map(spark, str(tmp_path)).collect()) == [
        ("x", "S"), ("y", "T")]
    folder = tmp_path / "arrays"
    folder.mkdir()
    (folder / "a.json").write_text("[]")
    (folder / "b.json").write_text('[{"id": "1"}, {"id": "2", "title": "[}"}]')
    (folder / "c.json").write_text('\ufeff[\n{"id": "3"}\n]\n', encoding="utf-8")
    jobs = readers.read_job_array(spark, str(folder)).orderBy("pos").collect()
    assert [(row.id, row.title) for row in jobs] == [("1", None), ("2", "[}"), ("3", None)]


def write_drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [HEADER] + [f"{title},Acme,,,,,,{text},,{link},Oslo" for title, text, link in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_stream_import_merges_files_once(spark, tmp_path):
    rules = Rules(keywords=(("go", 9),), target_role="dev")
    drop, catalog, marks = tmp_path / "drop", str(tmp_path / "catalog"), str(tmp_path / "marks")
    header = tuple(HEADER.split(","))

    def run():
        stream_import(spark, str(drop), header, catalog, marks, rules, F.lit("2026-01-02").cast("date")).awaitTermination()
        return sorted((row.title, row.job_link, row.score) for row in read_catalog(spark, catalog).collect())
    write_drop(drop, "a.csv", [("Dev 1", "go", "l1"), ("Dev 1b", "x", "l1"), ("Cook", "go", "l2")])
    assert run() == [("Dev 1", "l1", 9)]
    write_drop(drop, "b.csv", [("Dev 9", "x", "l1"), ("Dev 5", "x", "l5")])
    assert run() == [("Dev 1", "l1", 9), ("Dev 5", "l5", 0)]
    assert run() == [("Dev 1", "l1", 9), ("Dev 5", "l5", 0)]


JOBS_SCHEMA = "id string, job_link string, score int, tier string, ai_reasoning string, regex_score int"


def test_catalog_merges_by_bucket_and_compacts(spark, tmp_path):
    catalog = str(tmp_path / "catalog")

    def held():
        rows = read_catalog(spark, catalog, spark.createDataFrame([], JOBS_SCHEMA).schema).collect()
        return sorted((row.id, row.score, row.ai_reasoning) for row in rows)

    def merge(rows, writer, upgrade=True):
        jobs = spark.createDataFrame([(name, f"l{name}", score, "t", reason, 1) for name, score, reason in rows], JOBS_SCHEMA)
        merge_batch(spark, catalog, jobs, writer, upgrade, buckets=4)
    # a batch job's catalog has no model columns and is honoured
    spark.createDataFrame([("a", "la", 1, "t"), ("b", "lb", 2, "t")], "id string, job_link string, score int, tier string").write.parquet(catalog)
    merge([("a", 9, None), ("c", 3, None)], "s-0", upgrade=False)
    assert held() == [("a", 1, None), ("b", 2, None), ("c", 3, None)]
    merge([("a", 9, "why"), ("b", 9, None), ("c", 8, "so"), ("d", 4, None)], "s-1")
    expected = [("a", 9, "why"), ("b", 2, None), ("c", 8, "so"), ("d", 4, None)]
    assert held() == expected
    merge([("a", 9, "why"), ("b", 9, None), ("c", 8, "so"), ("d", 4, None)], "s-1")  # the same micro-batch again
    assert held() == expected
    merge([("a", 5, "later"), ("d", 6, "now")], "other-0")
    expected = [("a", 9, "why"), ("b", 2, None), ("c", 8, "so"), ("d", 6, "now")]
    assert held() == expected
    for number in range(3):
        merge([(f"n{number}{at}", at, None) for at in range(8)], f"s-{number + 2}")
    expected = sorted(expected + [(f"n{number}{at}", at, None) for number in range(3) for at in range(8)])
    assert compact(spark, catalog, buckets=4, most=2)
    assert held() == expected
    assert compact(spark, catalog, buckets=4, most=2) == []
    merge([("b", 7, "at last"), ("n00", 7, "too")], "s-9")
    assert [row for row in held() if row[0] in ("b", "n00")] == [("b", 7, "at last"), ("n00", 7, "too")]


def stream_parts(spark, tmp_path, parts):
    """What the change feed holds after the parts have arrived one after the other."""
    schema = "id string, ts int, status string"
    for number, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(number)))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        stream_changes(events, "id", ["ts"], ["status"], F.lpad(F.floor(F.col("ts") / 3).cast("string"), 5, "0"),
                       str(tmp_path / "feed"), str(tmp_path / "marks")).awaitTermination()
    return sorted((row.id, row.ts, row.kind) for row in spark.read.parquet(str(tmp_path / "feed")).collect())


def test_stream_changes_remembers_the_last_row(spark, tmp_path):
    got = stream_parts(spark, tmp_path, [
        [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y")], [("a", 3, "x"), ("a", 4, "z"), ("c", 3, "x")], [("b", 9, "y"), ("a", 9, "x")]])
    assert got == [("a", 1, "snapshot"), ("a", 4, "update"), ("a", 9, "update"), ("b", 1, "snapshot"), ("c", 3, "snapshot")]


def test_late_events_take_their_place(spark, tmp_path):
    got = stream_parts(spark, tmp_path, [
        [("a", 5, "x"), ("a", 6, "x"), ("a", 12, "x"), ("b", 5, "x"), ("c", 5, "x"), ("c", 9, "x")],
        # before all stored ones; between equal ones of one block and of two; equal to its neighbour; null status
        [("a", 2, "y"), ("a", 8, "y"), ("b", 1, "x"), ("c", 7, None)]])
    assert got == [("a", 2, "update"), ("a", 5, "snapshot"), ("a", 8, "update"), ("a", 12, "update"), ("b", 1, "update"),
                   ("b", 5, "snapshot"), ("c", 5, "snapshot"), ("c", 7, "update"), ("c", 9, "update")]


def test_places_sort_as_their_values(spark):
    from rolescope.streaming.changes import sortable
    rows = spark.createDataFrame([(value,) for value in (None, -5, 10, 9, 0, -(1 << 63), (1 << 63) - 1)], "n long")
    found = [row.n for row in rows.orderBy(sortable(rows, "n")).collect()]
    assert found == [None, -(1 << 63), -5, 0, 9, 10, (1 << 63) - 1]


def test_artifacts_and_json(spark, tmp_path):
    rows = [(1, "a", "Acme", "Dev", "doc", "N/A", "Match", 8, "u", "")]
    jobs = spark.createDataFrame(rows, "row_no long, id string, company string, title string, resume_text string, salary string, "
                                       "tier string, score int, apply_link string, job_link string")
    writers.write_artifacts(jobs, str(tmp_path / "files"))
    got = {row.path: row.content for row in spark.read.parquet(str(tmp_path / "files")).collect()}
    assert got["Acme/Dev/resume.txt"] == "doc"
    assert got["Acme/Dev/info.txt"].splitlines()[-1] == "Apply Link: u"
    writers.write_json_catalog(jobs, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().company == "Acme"


def test_catalog_reads_by_label_and_new_columns_are_null(spark, tmp_path):
    from rolescope.schemas import JOBS
    jobs = spark.createDataFrame([("a", "2026-01-01", 3), ("b", "2026-01-02", 4)], "id string, import_date string, score int")
    writers.write_catalog(jobs, str(tmp_path / "catalog"))
    back = readers.read_table(spark, str(tmp_path / "catalog"), JOBS).filter("import_date = '2026-01-02'")
    assert [(row.id, row.score, row.ai_resume_status) for row in back.collect()] == [("b", 4, None)]
    assert "PartitionFilters: [isnotnull(import_date" in back._jdf.queryExecution().executedPlan().toString()


def test_request_file(spark, tmp_path):
    from rolescope.operators.model_scoring import scoring_requests
    jobs = spark.createDataFrame([("a", "Acme", "Dev", "Requirements: go")], "id string, company string, title string, description string")
    writers.write_requests(scoring_requests(jobs, "Rate it.", "small"), str(tmp_path / "requests"))
    lines = [json.loads(line) for file in (tmp_path / "requests").glob("*.txt") for line in file.read_text().splitlines()]
    assert lines[0]["custom_id"] == "a" and lines[0]["params"]["max_tokens"] == 512
    assert lines[0]["params"]["messages"][0]["content"].endswith("(relevant excerpt):\nRequirements: go")
    assert lines[0]["params"]["system"][0]["cache_control"] == {"type": "ephemeral", "ttl": "1h"}


def test_pages_without_status_codes(spark, tmp_path):
    spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    assert readers.read_pages(spark, str(tmp_path / "p")).first().http_code is None


def test_command_line_cleaning_keeps_the_link_text(spark):
    from rolescope.functions.normalize import cleaned
    from rolescope.operators.dedup import first_postings
    rows = [(1, " A ", " T ", " x ", " S "), (2, "B", "U", "x", "")]
    frame = spark.createDataFrame(rows, "row_no int, company string, title string, job_link string, salary string")
    kept = cleaned(frame, trim_all=False)
    assert [(row.company, row.job_link, row.link_key, row.salary) for row in kept.orderBy("row_no").collect()] == [
        ("A", " x ", "x", " S "), ("B", "x", "x", "N/A")]
    assert [row.row_no for row in first_postings(kept).collect()] == [1]


def test_rows_are_spread_only_where_asked(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(100)
    assert "Exchange" not in plan(readers.spread(rows, "id"))
    assert readers.spread(rows, "id", 3).rdd.getNumPartitions() == 3


def test_late_events_over_many_shelves(spark, tmp_path, monkeypatch):
    """State calls of a key follow its shelves, not its blocks, and shelves are cut without changing what is told."""
    import random

    import pandas as pd

    from rolescope.streaming import changes

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Shelves(dict):
        calls = 0

        def getValue(self, key):
            Shelves.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            Shelves.calls += 1
            self[key] = value

    def run(rows, parts, most):
        monkeypatch.setattr(changes, "SHELF_EVENTS", most)
        feed = changes.Changes(plain=True)
        feed.shelves, feed.events, told = Value(), Shelves(), []
        for part in range(parts):
            batch = [(f"{at // 3:05d}", f"{at:05d}", sign, f"{at}") for at, sign, number in rows if number == part]
            frame = pd.DataFrame(batch, columns=["block", "place", "sign", "row"], dtype=object)
            for out in feed.handleInputRows(("a",), iter([frame]), None) if batch else ():
                told += [(int(row), kind, part) for row, kind in zip(out["row"], out["kind"], strict=True)]
        return sorted(told), feed.events

    draw = random.Random(5)
    rows = [(at, draw.choice("xy"), draw.randrange(4)) for at in range(300)]
    expected, told = [], set()
    for part in range(4):
        here = [row for row in rows if row[2] <= part]
        for place, (at, sign, _) in enumerate(here):
            if at not in told and (place == 0 or here[place - 1][1] != sign):
                told.add(at)
                first = place == 0 and part == min(number for _, _, number in rows)
                expected.append((at, "snapshot" if first else "update", part))
    for most in (4, 30, 10_000):
        got, held = run(rows, 4, most)
        assert got == sorted(expected)
        assert sorted(event[1] for (events,) in held.values() for event in events) == [f"{at:05d}" for at in range(300)]
        assert most == 10_000 or max(len(events) for (events,) in held.values()) <= max(most, 3)
    Shelves.calls = 0
    run([(at, "x", at % 2) for at in range(90)], 2, 128)
    assert Shelves.calls == 3  # one shelf: written, read, written
