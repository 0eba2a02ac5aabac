import datetime as dt
import json
import zipfile

from ledgerloom import schemas
from ledgerloom.operators import acquisition as A
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import ingest


def ms(day):
    return int(dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def listing(spark, *rows):
    return spark.createDataFrame([(c, t, u, ms(d) if d else None, p) for c, t, u, d, p in rows], schemas.ANNOUNCEMENTS)


def wanted(spark):
    return A.targets(spark.createDataFrame([("600001", "甲", None, None, None), ("600002", "乙", None, None, None)], schemas.COMPANIES), ["2024"], ["2024"])


def test_picks_the_newest_without_stop_words(spark):
    rows = listing(
        spark, ("600001", "甲：2024年年度报告", "/a.PDF", "2025-03-01", 0), ("600001", "甲：2024年年度报告（修订版）", "b.PDF", "2025-04-01", 1), ("600001", "甲：2024年年度报告摘要", "c.PDF", "2025-05-01", 2),
        ("600001", "<em>2024年年度报告</em>英文", "d.PDF", "2025-05-01", 3), ("600001", "关于2024年年度报告的公告", "e.PDF", "2025-05-02", 4), ("600002,600001", "2024年半年度报告全文", None, "2024-08-01", 5), (None, None, None, None, 6),
        ("600002", "2024年年度报告", "late.PDF", "2025-11-01", 7), ("600002", "2024年年度报告", "tie.PDF", "2025-11-01", 8),
    )
    got = {(r["code"], r["report_type"]): r for r in A.pick_reports(wanted(spark), rows.union(rows)).collect()}
    assert got["600001", "annual"]["url"].endswith("/b.PDF") and len(got["600001", "annual"]["candidates"]) == 2 and not got["600001", "annual"]["wide"]
    assert got["600002", "annual"]["wide"] and got["600002", "annual"]["url"].endswith("late.PDF")
    assert {k for k in got} == {("600001", "annual"), ("600002", "annual"), ("600001", "semi"), ("600002", "semi")}
    only = A.pick_reports(wanted(spark), rows.limit(0))
    assert A.missing_targets(wanted(spark), only).count() == 4


def test_upsert_swaps_tables(spark, tmp_path):
    path = str(tmp_path / "manifest")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, pages int")
    sinks.upsert(spark, path, first, "doc_id")
    sinks.upsert(spark, path, spark.createDataFrame([("b", 5), ("c", None)], "doc_id string, pages int"), "doc_id")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 5), ("c", None)}
    assert [p.name for p in tmp_path.iterdir()] == ["manifest"]


def test_json_lines(spark, tmp_path):
    assert readers.read_jsonl(spark, str(tmp_path / "none"), schemas.DOC_STATS).count() == 0
    sinks.write_jsonl(spark.createDataFrame([("文", 1)], "doc_id string, pages int"), str(tmp_path / "x"))
    assert readers.read_jsonl(spark, str(tmp_path / "x"), schemas.DOC_STATS).first()["doc_id"] == "文"
    (tmp_path / "D1").mkdir()
    (tmp_path / "D1" / "doc_stats.json").write_text('{"doc_id": "D1",\n "pages": 3}')
    assert readers.read_doc_stats(spark, str(tmp_path / "*" / "doc_stats.json")).first()["pages"] == 3


def test_configuration(spark, tmp_path):
    (tmp_path / "c.yml").write_text("periods: {annual: [2024, 2025], semi: [2025]}\ncompanies:\n- {code: '600001', name: 甲}\n", encoding="utf-8")
    companies, periods = readers.read_companies(spark, str(tmp_path / "c.yml"))
    assert A.targets(companies, **periods).count() == 3
    (tmp_path / "q.yml").write_text("questions:\n- {id: q1, question: 问, k: 8}\n- {id: q2}\n", encoding="utf-8")
    assert readers.read_questions(spark, str(tmp_path / "q.yml"), ["q1"]).first()["k"] == 8


def test_page_listing_stops(spark, tmp_path):
    for name, pages, total in (("t1", [2, 2, 0, 2], 9), ("t2", [1, 1, 1], 2)):
        (tmp_path / name).mkdir()
        for i, n in enumerate(pages):
            rows = [{"secCode": "600001", "announcementTitle": f"{i}-{j}", "adjunctUrl": "x", "announcementTime": 5} for j in range(n)]
            (tmp_path / name / f"{i}.json").write_text(json.dumps({"totalAnnouncement": total, "announcements": rows}))
    spark.dataSource.register(readers.PageListing)
    got = spark.read.format("page_listing").option("path", str(tmp_path)).load()
    assert {r["target"]: r["count"] for r in got.groupBy("target").count().collect()} == {"t1": 4, "t2": 2}


def test_documents_are_checked(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF" + b"x" * 2000)
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.pdf").write_bytes(b"<html>" + b"x" * 2000)
    got = {r["path"].rsplit("/", 1)[1]: r["valid"] for r in readers.read_documents(spark, str(tmp_path / "*.pdf")).collect()}
    assert got == {"a.pdf": True, "b.pdf": False, "c.pdf": False}


def test_archives_and_pages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "D1.zip", "w") as z:
        z.writestr("x/middle_json.json", '{"pages": []}')
    with zipfile.ZipFile(tmp_path / "D2.zip", "w") as z:
        z.writestr("other.txt", "")
    got = {r["doc_id"]: r["layout"] for r in readers.read_layout_archives(spark, str(tmp_path / "*.zip")).collect()}
    assert got == {"D1": '{"pages": []}', "D2": None}
    (tmp_path / "a.pdf").write_bytes(b"%PDF /Type /Pages /Type /Page x /Type/Page>" + b" " * 2000)
    (tmp_path / "b.pdf").write_bytes(b"no pages")
    assert {r["pages"] for r in readers.read_documents(spark, str(tmp_path / "*.pdf")).collect()} == {2, None}


def test_reports(spark, tmp_path):
    sinks.csv_with_bom(spark.createDataFrame([("q1", "是")], "id string, verdict string"), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,verdict")
    ev = spark.createDataFrame([("q1", "问", 2, "甲", "L", "S", 3, 0.5), ("q1", "问", 1, "乙", "L", "S", 4, 0.6)], "qid string, question string, idx int, company string, report_label string, section string, page int, score double")
    assert sinks.markdown(ev).first()["page"].split("\n")[2].startswith("1. 乙")


def test_streams(spark, tmp_path):
    (tmp_path / "in" / "D1").mkdir(parents=True)
    (tmp_path / "in" / "D1" / "l.json").write_text('{"pages": [{"page_idx": 0, "blocks": [{"type": "text", "content": "甲"}]}]}')
    run = lambda: ingest.ingest_layouts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    run()
    (tmp_path / "in" / "D2").mkdir()
    (tmp_path / "in" / "D2" / "l.json").write_text('{"pages": []}')
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1

    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.json").write_text('{"doc_id": "a", "pages": 1, "downloaded_at": "1"}\n{"doc_id": "a", "pages": 2, "downloaded_at": "2"}\n')
    ingest.upsert_manifest(spark, str(tmp_path / "m"), str(tmp_path / "t"), str(tmp_path / "cp2")).awaitTermination(120)
    (tmp_path / "m" / "2.json").write_text('{"doc_id": "b", "pages": 7}\n')
    ingest.upsert_manifest(spark, str(tmp_path / "m"), str(tmp_path / "t"), str(tmp_path / "cp2")).awaitTermination(120)
    assert {(r["doc_id"], r["pages"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 2), ("b", 7)}


def test_event_windows_as_a_stream(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i // 30, i % 30 * 2), i % 3, "view", 1.0) for i in range(90)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    events.write.parquet(str(tmp_path / "e"))
    stream = ingest.event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    same = lambda df: {(r["window_start"], r["n"]) for r in df.collect()}
    assert same(spark.table("w")) == same(ingest.event_windows(events)) and ingest.user_sessions(events).count() == 3
