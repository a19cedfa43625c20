"""From files to findings: one call over a batch, and the same by a stream that is killed and started again."""

import gzip
import io
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from rowcheck.operators.intake import take_in
from rowcheck.queries import QUERIES
from rowcheck.plans.spec import shaped
from rowcheck.sources import files, sinks
from rowcheck.staging import ORDERS, read_statements
from rowcheck.streaming import streams

RULES = (shaped("status", "[FO]"),)
LANDED = {
    "a.csv": b"Invoice Number;Status;Total\nINV-000001;F;1,50\nINV-000002;P;2\n",
    "blank.csv": b"Invoice Number;;\nINV-000003;1;2\n",
    "claimed.csv": "﻿Invoice Number,invoice-number\nINV-000004,x\n".encode(),
    "wide.csv": b"Invoice Number\tStatus\nINV-000005\tF\tmore\n",
    "late.csv": b'Invoice Number|Status|Total\n"INV-\n000006"|O|x1\n',
    "p1.bin": b"%PDF-1.7 names INV-000000012 and INV-000000013 and INV-000000022 and INV-000000033\nline INV-000000012 F 1.5\nline INV-000000013 P 2\nline INV-000000022 F 3\nline INV-000000033 F 3\n",
    "p2.bin": b"%PDF-1.7 " + b"nothing that could be read as a row stands here " * 3,
    "odd.bin": b"\x00\x01\x02 no kind that is known",
}


@pytest.fixture()
def folder(tmp_path):
    for name, raw in LANDED.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(raw)
    return tmp_path


def tables(rows, found, log):
    name = F.element_at(F.split("doc_id", "/"), -1).alias("doc")
    return [
        sorted(map(str, df.select(name, *columns).collect()))
        for df, columns in (
            (rows, ("row_idx", "invoice_number", "status", F.col("total").cast("string"), F.size("findings"), sinks.STATUS)),
            (found, ("row_idx", "column", "rule", "detail", "value")),
            (log, ("route", "rows", "failures", "outcome", "calls")),
        )
    ]


def batch(spark, folder):
    landed = spark.read.format("binaryFile").load(str(folder / "in"))
    taken = take_in(landed, ORDERS, RULES, extractor=read_statements)
    return tables(taken.rows, taken.found, taken.log)


def test_every_kind_of_document(spark, folder):
    rows, found, log = batch(spark, folder)
    assert len(rows) == 5 and sum("flagged" in r for r in rows) == 3
    rules = sorted((r.split("doc='")[1].split("'")[0], r.split("rule='")[1].split("'")[0]) for r in found)
    assert rules == [
        ("a.csv", "pattern"), ("blank.csv", "malformed"), ("claimed.csv", "malformed"), ("late.csv", "type"), ("odd.bin", "unsupported"),
        ("p1.bin", "incomplete"), ("p1.bin", "pattern"), ("p2.bin", "empty"), ("wide.csv", "malformed"),
    ]
    outcomes = {r.split("doc='")[1].split("'")[0]: r.split("outcome='")[1].split("'")[0] for r in log}
    assert outcomes == {
        "a.csv": "flagged", "blank.csv": "error", "claimed.csv": "error", "late.csv": "flagged", "odd.bin": "error", "p1.bin": "flagged",
        "p2.bin": "flagged", "wide.csv": "error",
    }


def test_a_stream_killed_and_started_again_gives_the_batch(spark, folder, monkeypatch):
    """The second micro-batch dies with its rows, findings and log written but not committed; nobody sees them, and they come once."""
    out, calls, commit = str(folder / "out"), [], sinks.commit

    def dies(session, path, key, replace=False):
        calls.append(key)
        if len(calls) == 2:
            raise RuntimeError("killed")
        commit(session, path, key, replace)

    def run():
        landed = streams.landing_files(spark, str(folder / "in"), 3)
        streams.stream_intake(landed, ORDERS, RULES, out, str(folder / "checkpoint"), extractor=read_statements).awaitTermination()

    monkeypatch.setattr(sinks, "commit", dies)
    with pytest.raises(StreamingQueryException):
        run()
    assert sinks.committed(spark, out, "log").count() == 3 and spark.read.parquet(f"{out}/log").count() == 6
    run()
    assert len(calls) == 4 and calls[1] == calls[2]
    assert tables(*(sinks.committed(spark, out, t) for t in ("rows", "findings", "log"))) == batch(spark, folder)


def test_an_append_that_died_is_repeated_under_its_key(spark, tmp_path, monkeypatch):
    """Two appends, the second killed between rows and findings and repeated: what one write of both would give; the first is not read again."""
    from rowcheck.operators.gate import gate

    one = spark.createDataFrame([("d1", 0, "I1", "F"), ("d1", 1, "I2", "P")], "doc_id string, row_idx int, invoice_number string, status string")
    two = spark.createDataFrame([("d2", 0, "I3", "P")], one.schema)
    path, put = str(tmp_path / "split"), sinks.put
    sinks.write_gated(gate(one, ORDERS, RULES), path, "b1", replace=False)
    monkeypatch.setattr(sinks, "put", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        sinks.write_gated(gate(two, ORDERS, RULES), path, "b2", replace=False)
    assert sinks.committed(spark, path, "rows").count() == 2 and spark.read.parquet(f"{path}/rows").count() == 3
    monkeypatch.setattr(sinks, "put", put)
    for _ in range(2):
        sinks.write_gated(gate(two, ORDERS, RULES), path, "b2", replace=False)
    whole = str(tmp_path / "whole")
    sinks.write_gated(gate(one.unionByName(two), ORDERS, RULES), whole)
    for name in ("rows", "findings"):
        a, b = (sinks.committed(spark, p, name).drop("batch") for p in (path, whole))
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    sinks.write_gated(gate(two, ORDERS, RULES), path, "b3")
    assert sinks.committed(spark, path, "rows").count() == 1


def test_blank_headings():
    """One heading may be blank, two are refused like any heading that comes twice."""
    assert files.parse_delimited("a;;b\n1;2;3\n") == (["a", "", "b"], [["1", "2", "3"]])
    assert files.parse_delimited("a;b;\n1;2;\n3;4;;\n") == (["a", "b", ""], [["1", "2", ""], ["3", "4", ""]])
    for text in ("a;;\n1;2;3\n", "a; ;b;\t\n1;2;3\n"):
        with pytest.raises(ValueError, match="more than one"):
            files.parse_delimited(text)


def test_micro_batches_follow_bytes(spark, monkeypatch):
    """23 files of a few KB are one micro-batch of the query, not three: small files do not make batches."""
    calls, commit = [], sinks.commit
    monkeypatch.setattr(sinks, "commit", lambda session, path, key, replace=False: (calls.append(key), commit(session, path, key, replace)))
    log = QUERIES["m01_stream_intake"](spark, "/root/testdata/sf0.001")
    assert log.count() == 23 and len(calls) == 1


def test_rows_come_some_at_a_time(monkeypatch):
    """What a file gives is handed on in pieces; a file that is malformed at its end gives its error alone."""
    monkeypatch.setattr(files, "HANDED_ON", 2)
    text = 'a;b\r\n1;"x\r\ny"\r2;z\n\n3;\n4;4;;\n5;5'
    pieces = list(files._parsed("f", text.encode(), None))
    assert [len(p) for p in pieces] == [2, 2, 2, 1]
    assert [(r[4], r[5]) for p in pieces[1:] for r in p] == [
        (0, ["1", "x\r\ny"]), (1, ["2", "z"]), (2, ["3", ""]), (3, ["4", "4"]), (4, ["5", "5"])
    ]
    assert [len(p) for p in files._parsed("f", f"{text};6".encode(), None)] == [1]


def test_no_row_of_a_landing_holds_a_large_file(spark, tmp_path):
    """A file of 6 MB lands in pieces that are its bytes; no row holds more than about a KB of it. Small files come whole."""
    (tmp_path / "in").mkdir()
    raw = b"Invoice Number;Status;Total\r\n" + b"".join(b"INV-%09d;F;1.50\n" % k for k in range(300_000)) + b"INV-300000;P;2"
    (tmp_path / "in" / "large +%41 [x].csv").write_bytes(raw)
    (tmp_path / "in" / "small.csv").write_bytes(b"\xef\xbb\xbf")
    seen = []
    stream = streams.landing_files(spark, str(tmp_path / "in"))
    once = stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c"))
    once.trigger(availableNow=True).start().awaitTermination()
    assert len(raw) > files.LARGE and max(len(r.content) for r in seen) < 2 * files.PIECE
    paths = {r.path for r in spark.read.format("binaryFile").load(str(tmp_path / "in")).select("path").collect()}
    assert {r.path for r in seen} == paths
    pieces = sorted((r for r in seen if r.begin is not None), key=lambda r: (r.begin, r.seq))
    assert len({(r.begin, r.seq) for r in pieces}) == len(pieces) and {r.length for r in pieces} == {len(raw)}
    assert b"".join(bytes(r.content) for r in pieces) == raw + b"\n"
    assert [bytes(r.content) for r in seen if r.begin is None] == [b"\xef\xbb\xbf"]


def test_files_in_pieces_give_the_batch(spark, folder, monkeypatch):
    """Whatever does not fit a few bytes comes in pieces: the tables are those of files that come whole. Packed files stay packed."""
    place = folder / "in"
    (place / "some +%41 [x].csv").write_bytes(b'\xef\xbb\xbfInvoice Number;Status;Total\r\n"INV-000007";"O";"x ""2""\n"\rINV-000008;P;3')
    (place / "latin.csv").write_bytes(b"Invoice Number;Status;Total\nINV-000009;\xe4;3\n\x81;F;4\n")
    (place / "wide.txt").write_bytes("Invoice Number;Status\nINV-000010;F\n".encode("utf-16"))
    (place / "cut.txt").write_bytes("Invoice Number;Status\nINV-000010;F\n".encode("utf-16")[:-1])
    (place / "packed.csv.gz").write_bytes(gzip.compress(b"Invoice Number;Status\nINV-000011;P\n"))
    want, out = batch(spark, folder), str(folder / "out")
    monkeypatch.setattr(files, "LARGE", 16)
    landed = streams.landing_files(spark, str(place))
    streams.stream_intake(landed, ORDERS, RULES, out, str(folder / "checkpoint"), extractor=read_statements).awaitTermination()
    assert tables(*(sinks.committed(spark, out, t) for t in ("rows", "findings", "log"))) == want
    assert not any((folder / "out" / "parsed").iterdir())


def pieces_of(raw, rng):
    """A file as Spark's text reader gives its lines, from two splits."""
    lines = raw.removeprefix(b"\xef\xbb\xbf").removesuffix(b"\n").split(b"\n")
    cut = rng.randrange(len(lines) + 1)
    for begin, some in ((0, lines[:cut]), (9, lines[cut:])):
        if some:
            numbers = [pa.array([x] * len(some), pa.int64()) for x in (len(raw), begin)]
            columns = [pa.array(["f"] * len(some)), *numbers, pa.array(some, pa.binary())]
            yield from files._by_bytes(iter([pa.RecordBatch.from_arrays(columns, names=["path", "length", "begin", "content"])]))


def test_a_file_in_pieces_is_parsed_as_a_whole_one(monkeypatch):
    """Bytes, records and errors of files of all charsets, with marks, cut characters, quotes and line ends of every kind."""
    rng = random.Random(4)
    marks = [(b"", "utf-8"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\x00\x00\xfe\xff", "utf-32-be")]
    for _ in range(1500):
        for name in ("PIECE", "READ"):
            monkeypatch.setattr(files, name, rng.choice((1, 3, 7, 1 << 20)))
        mark, charset = rng.choice(marks)
        raw = "".join(rng.choice('ab;;1 "ä\u2028\t\n\r') for _ in range(rng.randrange(1, 50))).encode(charset)
        if rng.random() < 0.5:
            at = rng.randrange(len(raw))
            raw = raw[:at] + rng.choice((b"", b"\xff", b"\x81", b"\x85", b"\r\n", b"\x00")) + raw[at + rng.randrange(2) :]
        if not raw:
            continue
        raw = mark + raw
        ((path, file),) = [(path, io.BytesIO(file.read())) for path, file in files._files(pieces_of(raw, rng))]
        assert path == "f" and file.getvalue() == raw
        want, got = ([r for some in parsed for r in some] for parsed in (files._parsed("f", raw, None), files._parsed_file("f", file)))
        assert got == want, raw


def test_kinds_of_single_files(spark):
    """kind_of says what classify_files says."""
    zipped = []
    for name, held in (("xl/a.xml", b""), ("mimetype", files.ODS), ("other", b"")):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr(name, held)
        zipped.append(buffer.getvalue())
    raws = [*zipped, *LANDED.values(), *files.IMAGES, files.OLE2, b"RIFF1234WEBP", b"RIFF1234WAVE", b"PK\x03\x04", b"", b"a" * 1023 + b"%PDF-",
            b" " * 1019 + b"%PDF-", b"a" * 8192 + b"\x00", b"a" * 8191 + b"\x00", b"\xff\xfea\x00", b"\x00\x00\xfe\xff\x00", b"\xe4"]
    landed = spark.createDataFrame([(str(k), raw) for k, raw in enumerate(raws)], "path string, content binary")
    got = {int(r.path): r.kind for r in files.classify_files(landed).collect()}
    assert got == {k: files.kind_of(io.BytesIO(raw)) for k, raw in enumerate(raws)}
    assert set(got.values()) == {"pdf", "spreadsheet", "image", "text", "unsupported"}
