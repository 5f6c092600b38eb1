"""Sources, sinks, streams and the stage runner on files."""

from __future__ import annotations

import json

from tintero.plans import pipeline
from tintero.sources import readers, writers
from tintero.streaming import ingest


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a.pdf", 1, 'uno "dos"\n\ntres, ñ'), ("b.pdf", 2, None)], readers.PAGES)
    writers.csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, readers.csv(spark, str(tmp_path / "c"), readers.PAGES).collect()))[0] == ("a.pdf", 1, 'uno "dos"\n\ntres, ñ')
    writers.json_lines(df, str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), readers.PAGES).where("text IS NULL").count() == 1
    (tmp_path / "a.json").write_text(writers.json_array(df).first()["json"], encoding="utf-8")
    assert readers.json_array(spark, str(tmp_path / "a.json"), readers.PAGES).count() == 2


def test_twin_routing_and_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "scanned"), (2, "x", "editable")], "i int, reason string, pdf_type string")
    writers.twin(df, "reason", str(tmp_path / "g"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "g")).first()["i"] == 1 and spark.read.parquet(str(tmp_path / "b")).first()["i"] == 2
    writers.routed(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).where("pdf_type = 'editable'").first()["i"] == 2
    for _ in range(2):
        writers.batch(df, str(tmp_path / "n"), 0)
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2


def test_folder_listing(spark, tmp_path):
    for n in ("a.pdf", "B.PDF", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert {r["pdf_filename"] for r in readers.files(spark, str(tmp_path)).collect()} == {"a.pdf", "B.PDF"}


def test_running_totals_over_two_batches(spark, tmp_path):
    src, out = tmp_path / "in", []
    stream = None
    for k, rows in enumerate([[(1, 7, 1.0), (2, 7, 2.0)], [(3, 7, 4.0), (4, 8, 1.0)]]):
        df = spark.createDataFrame([(i, None, u, "t", v, "{}") for i, u, v in rows], ingest.EVENTS)
        df.coalesce(1).write.mode("append").parquet(str(src))
        stream = ingest.running_totals(ingest.folder(spark, str(src), ingest.EVENTS))
        stream.writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    assert (7, 2, 3.0) in out and (7, 3, 7.0) in out and (8, 1, 1.0) in out


def test_sessions_leave_out_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("SELECT 1L AS event_id, timestamp'2024-01-01 00:00:00' AS ts, 5L AS user_id, 'a' AS event_type, 1.0D AS value, '{}' AS props UNION ALL SELECT 2L, timestamp'2024-01-01 00:10:00', 5L, 'a', 2.0D, '{}' UNION ALL SELECT 3L, timestamp'2024-01-01 09:00:00', 5L, 'a', 4.0D, '{}'").coalesce(1).write.parquet(str(src))
    q = ingest.sessions(ingest.folder(spark, str(src), ingest.EVENTS))
    ingest.append_available(q, str(tmp_path / "o"), str(tmp_path / "s"))
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    assert [(r["user_id"], r["n_events"], r["total"]) for r in got] == [(5, 2, 3.0)]


def test_runner(spark, tmp_path, capsys):
    data = tmp_path / "data"
    data.mkdir()
    body = "El gasto corriente subió en el último año por la sequía y por los precios de los alimentos, según el informe anual."
    (data / "list_rows.json").write_text(json.dumps([{"date": "04/05/2020", "doc_title": "Informe N° 001-2020-CF", "page_url": "u1", "pdf_url": "h/a.pdf", "pdf_filename": "a.pdf"}]), encoding="utf-8")
    noise = "\n\n7/10\n\n"
    pages = [{"pdf_filename": "a.pdf", "page": 1, "text": body + "\n\n" + body}, {"pdf_filename": "s.pdf", "page": 1, "text": "x" + noise}]
    (data / "pages.json").write_text(json.dumps(pages), encoding="utf-8")
    run = pipeline.Runner(spark, pipeline.Config(str(data), str(tmp_path / "m"), str(tmp_path / "o")))
    assert set(run.run().values()) == {"ok"}
    assert all(run.status().values())
    row = spark.read.parquet(str(tmp_path / "o" / "document_scores")).first()
    assert row["pdf_filename"] == "a.pdf" and row["n_paragraphs"] == 2
    kinds = {r["pdf_filename"]: r["pdf_type"] for r in spark.read.parquet(str(tmp_path / "o" / "kinds")).collect()}
    assert kinds == {"a.pdf": "editable", "s.pdf": "scanned"}
    # A later file is cleaned alone; a scanned one goes through the staged rules.
    (data / "pages2.json").write_text(json.dumps([{"pdf_filename": "t.pdf", "page": 1, "text": "breve"}]), encoding="utf-8")
    again = pipeline.Runner(spark, pipeline.Config(str(data), str(tmp_path / "m"), str(tmp_path / "o"), incremental=True, normalize=True))
    assert set(again.run().values()) == {"ok"}
    assert {r["pdf_filename"] for r in spark.read.parquet(str(tmp_path / "o" / "clean_pages")).select("pdf_filename").collect()} == {"a.pdf"}
    try:
        run.run(["nada"])
        raise AssertionError
    except ValueError:
        pass
    assert pipeline.main(["--list"]) == 0 and "collect" in capsys.readouterr().out
