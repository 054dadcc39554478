"""Rules and plans of the document engine on small fixtures."""

import http.server
import json
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docspeak import queries as Q
from docspeak.functions import speech
from docspeak.functions import text as T
from docspeak.operators import cleaner, layout, review, voices
from docspeak.plans import document
from docspeak.schema import BLOCKS, Settings
from docspeak.sources import blocks as B

SF = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF)
    want = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, want.fetchall()))


def test_review_service_down(spark):
    """A client that fails keeps every block, and counts them as processed."""
    rows = Q.seeded(spark, SF).where("doc_id < 5")

    def broken(payload):
        raise OSError("no service")

    got = review.reviewed(rows, broken)
    assert got.count() == rows.count() and {r["llm_dropped"] for r in got.select("llm_dropped").collect()} == {0}


def test_review_of_whole_documents(spark):
    """Reviewed blocks are cleaned once more; counts of both passes are put together as they were found."""
    rows = [("Results", "section_header"), ("We saw that it all went well.", "paragraph"), ("Junk to be dropped here.", "paragraph"), ("12", "paragraph"), ("A caption", "caption")]
    blocks = spark.createDataFrame([(1, i, t, label, 1, None) for i, (t, label) in enumerate(rows)], BLOCKS)
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0)], "doc_id long, page_no int, width double, height double")
    regions = spark.createDataFrame([], "doc_id long, kind string, page_no int, bbox struct<l:double,t:double,r:double,b:double>")
    answer = '{"order": [1, 0], "results": [{"id": 0, "action": "DROP"}, {"id": 2, "action": "DROP"}, {"id": 3, "action": "DROP"}]}'
    r = document.cleaned(blocks, pages, regions, client=lambda payload: answer).first()
    assert r["text"] == "We saw that it all went well.\n\nResults"
    assert (r["total_blocks"], r["kept_blocks"], r["dropped_blocks"], r["llm_blocks_processed"], r["llm_blocks_dropped"]) == (5, 2, 3, 5, 2)
    assert r["dropped_by_label"] == {"caption": 1} and r["dropped_by_rule"] == {"page_number": 1}
    nothing = '{"results": [' + ", ".join(f'{{"id": {i}, "action": "DROP"}}' for i in range(1, 5)) + "]}"
    r = document.cleaned(blocks, pages, regions, client=lambda payload: nothing).first()
    assert (r["text"], r["kept_blocks"], r["dropped_blocks"]) == ("Results", 1, 4)


def test_service_address():
    want = {" localhost:8000/v1/ ": "http://localhost:8000/v1", "https://h/a?b#c": "https://h/a", "": "", "ftp://h": None, "http://": None, "http://h:x": None}
    assert {k: review.service_url(k) for k in want} == want


def test_chat_client():
    """What is posted, and that an answer that isn't text is none."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "[]" if len(seen) == 1 else 7}}]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = review.chat_client(f"http://127.0.0.1:{server.server_port}/v1/", "Be brief.", "m", "k", timeout=5)
    assert ask("[1]") == "[]" and ask("[1]") is None
    server.shutdown()
    path, key, body = seen[0]
    assert path == "/v1/chat/completions" and key == "Bearer k" and body["temperature"] == 0 and body["model"] == "m"
    assert [m["content"] for m in body["messages"]] == ["Be brief.", "[1]"]


def test_what_is_written(spark, tmp_path):
    """Texts, and metadata before and after synthesis, read back as restored jobs; folders without sound or with bad metadata aren't jobs."""
    rows = Q.varied(spark, SF).where("doc_id < 4")
    pages, pictures = B.pages_of(rows), Q.pictures(rows)
    done = document.listen(rows, pages, pictures)
    statistics = document.stats(done, Q._page_counts(rows), pictures)
    job = {"job_id": F.concat(F.lit("job"), F.col("doc_id")), "filename": F.lit("a.pdf"), "created_at": F.lit("2024-01-02T03:04:05"), "source_pdf": F.concat(F.lit(f"{tmp_path}/up/job"), F.col("doc_id"), F.lit("/source.pdf"))}
    first, second = (document.metadata(done, statistics, job, spoken=k).collect() for k in (False, True))
    assert "voice" not in json.loads(first[0]["value"]) and json.loads(second[0]["value"])["voice"]["engine"] == "piper"
    stats = json.loads(second[0]["value"])["stats"]
    assert set(stats) == set(document.STATS) and stats["kept_blocks"] + stats["dropped_blocks"] == stats["total_blocks"]
    for r in [*second, ("../bad", second[0]["value"].replace('"job0"', '"../bad"'))]:
        folder = tmp_path / "out" / r[0].replace("../", "x")
        folder.mkdir(parents=True)
        (folder / "metadata.json").write_text(r[1])
        (folder / "reading.wav").write_bytes(b"RIFF")
    (tmp_path / "out" / "job1" / "cleaned_text.txt").write_text("t")
    (tmp_path / "out" / "job2" / "reading.wav").unlink()
    (tmp_path / "out" / "job3" / "metadata.json").write_text("{")
    (tmp_path / "up" / "job1").mkdir(parents=True)
    (tmp_path / "up" / "job1" / "source.pdf").write_bytes(b"%PDF-")
    got = {r["job_id"]: r for r in B.restored(spark, f"{tmp_path}/out", f"{tmp_path}/up").collect()}
    assert set(got) == {"job0", "job1"}
    assert got["job1"]["pdf_path"].endswith("/up/job1/source.pdf") and got["job1"]["text_path"].endswith("cleaned_text.txt") and got["job0"]["pdf_path"] is None
    assert got["job0"]["stats"]["pages"] == stats["pages"] and got["job0"]["progress"] == 1.0
    document.write_metadata(document.metadata(done, statistics, job), f"{tmp_path}/meta")
    document.write_texts(done, f"{tmp_path}/texts")
    assert spark.read.text(f"{tmp_path}/meta").count() == done.count()


def test_extractor(spark):
    """Blocks and pages through an extractor that fails for one file."""

    def fake(content):
        if content == b"bad":
            raise ValueError
        return '[{"text": " ", "caption_text": "Cap", "label": " Picture ", "prov": [{"page_no": 2, "bbox": [1, 2, 3, 4]}]}]', '[{"size": {"width": 10, "height": 20}}, {"page_no": 5, "size": {"width": 1, "height": 2}}, {}]'

    files = spark.createDataFrame([(1, b"x"), (2, b"bad")], "doc_id long, content binary")
    blocks, pages = B.extracted(files, fake)
    r = blocks.first()
    assert blocks.count() == 1 and (r["text"], r["label"], r["page_no"], r["bbox"]["r"]) == ("Cap", "picture", 2, 3.0)
    assert sorted((r["page_no"], r["width"]) for r in pages.collect()) == [(1, 10.0), (5, 1.0)]


def test_settings(monkeypatch):
    for k, v in {"MAX_PAGES": "7", "REVIEW_ENABLED": "Yes", "REVIEW_URL": " h ", "SPEECH_RATE_MAX": "1.5", "DATA_DIR": ""}.items():
        monkeypatch.setenv(f"DOCSPEAK_{k}", v)
    s = Settings.from_env()
    assert (s.max_pages, s.review_enabled, s.review_url, s.speech_rate_max, s.uploads) == (7, True, "h", 1.5, "data/uploads")


def test_html(spark):
    html = '<html><head><title>T &amp; U</title><script>var t="</p>";</script></head><body><nav><ul><li>x</ul></nav><h2>Head</h2><p>One <b>two</b><p>Three</body>'
    got = [(r["seq"], r["text"], r["label"]) for r in B.from_html(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("seq").collect()]
    assert got == [(0, "T & U", "title"), (1, "x", "list_item"), (2, "Head", "section_header"), (3, "One two", "paragraph"), (4, "Three", "paragraph")]


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_normalize(spark):
    assert one(spark, "R enal func- tion ­•  ok", T.normalize) == "Renal function ok"
    assert one(spark, "ﬁne", T.normalize) == "fine"
    assert one(spark, None, T.normalize) == ""


def test_speech(spark):
    assert one(spark, "p<0.05 and 224×224 at 78.3% with CT, e.g. Fig. 2 of 5 ± 2", speech.verbalize) == "p less than 0.05 and 224 by 224 at 78.3 percent with C.T., for example, Figure 2 of 5 plus or minus 2"
    assert one(spark, "1<2>3", speech.comparisons) == "1 less than 2>3"
    got = one(spark, "One sentence is here. Another one follows, with words. And a third.", lambda c: speech.chunks(c, 30))
    assert got == ["One sentence is here.", "Another one follows, with words.", "And a third."]


def test_merge(spark):
    parts = F.split(F.lit("The tumors inclu-|ding some|Short Heading|Then (open|Next"), r"\|")
    assert spark.range(1).select(speech.merge_parts(parts)).first()[0] == "The tumors including some\n\nShort Heading\n\nThen (open Next"


def test_cascade(spark):
    rows = [("References", "section_header"), ("Smith wrote it all in a long sentence", "paragraph"), ("Methods", "section_header"), ("We did this in a proper way.", "paragraph"), (None, "text"), ("x", None)]
    blocks = spark.createDataFrame([(1, i, t, label, None, None) for i, (t, label) in enumerate(rows)], BLOCKS)
    got = [r["reason"] for r in cleaner.with_reason(blocks).orderBy("seq").collect()]
    assert got == ["section_heading_drop", "section_skip", None, None, "empty", "non_prose"]


def test_more_than_four_columns(spark):
    blocks = spark.createDataFrame([(1, i, "x", "text", 1, (100.0 * i, 10.0, 100.0 * i + 20, 20.0)) for i in range(6)], BLOCKS)
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0)], "doc_id long, page_no int, width double, height double")
    assert len(layout.columns_of(blocks, pages).first()["cols"]) == 4


def test_voices(spark):
    got = [spark.range(1).select(voices.resolve(F.lit(a), F.lit(b), F.lit(c))).first()[0] for a, b, c in (("auto", "pt-PT", "kokoro"), ("nobody", None, "piper"), ("kokoro-en-bella", "pt", "piper"))]
    assert got == ["kokoro-pt-dora", "en_US-lessac-medium", "kokoro-en-bella"]


def test_one_shuffle_by_document(spark):
    plan = cleaner.with_reason(Q.seeded(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
