"""Files parsed in splits against the same files parsed whole."""

import csv
import io
import random

import pytest
from rowcheck.sources.files import read_delimited
from rowcheck.sources.splits import _separators, ends_inside, read_splits


def test_states_of_a_line():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice('a";\r ') for _ in range(rng.randint(0, 9)))
        for inside in (False, True):
            begun = ('"x\n' if inside else "") + text
            # a reader that is inside takes what follows as part of the cell
            rows = list(csv.reader(io.StringIO(begun + "\nEND;more", newline=""), delimiter=";"))
            assert ends_inside(text, inside, _separators(";")) == (rows[-1] != ["END", "more"]), (text, inside)


def cells(rng):
    return rng.choice(("plain", "5\" pipe", "", '"', "two\nlines", "a;b", 'say "x";\n\n"y', "\n" * 3, "é" * 5, "tab\there", "cr\r\nlf"))


@pytest.fixture()
def folder(tmp_path):
    rng = random.Random(8)
    (tmp_path / "in").mkdir()

    def put(name, rows, mark=";", end="\r\n", lead=""):
        out = io.StringIO(newline="")
        writer = csv.writer(out, delimiter=mark, lineterminator=end)
        writer.writerows(rows)
        (tmp_path / "in" / name).write_bytes((lead + out.getvalue()).encode())

    many = lambda n, w=4: [[cells(rng) for _ in range(w)] for _ in range(n)]
    put("large.csv", [["Key", "a", "", "b"], *many(900)])
    put("marked.csv", [["k", "x"], *many(60, 2)], "\t", "\n", "﻿")
    put("wide.csv", [["k", "x"], *many(200, 2), ["1", "2", "", "3"], *many(10, 2)], ",")
    put("twice.csv", [["k", "x", " K"], *many(30, 3)], "|", "\n")
    put("long.csv", [["k;x", "note"], ["1", "quoted\n" * 4000], ["2", 'a "b"\n' * 2500], *many(5, 2)])
    (tmp_path / "in" / "raw.csv").write_bytes(b'k;x\n5" pipe;"a\nb"\n\n;\n"c"d;7"\n' * 40)
    (tmp_path / "in" / "one.csv").write_bytes("just one column\nof text. And \"more\n".encode() * 50)
    (tmp_path / "in" / "blank.csv").write_bytes(b"\n \n\n")
    return str(tmp_path / "in")


@pytest.mark.parametrize("split", [37, 512, 1 << 20])
def test_splits_give_what_whole_files_give(spark, folder, split):
    """Splits of a few bytes, so that they begin anywhere: inside cells that are longer than many of them, between a pair of quotes' lines."""
    keys = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    if split == 37:  # some hundred splits a file are enough
        for name, most in (("large.csv", 40), ("wide.csv", 230), ("long.csv", 0)):
            with open(f"{folder}/{name}", newline="", encoding="utf-8") as f:
                rows = list(csv.reader(f, delimiter="," if name == "wide.csv" else ";"))
            rows = rows[:most] if most else [["k;x", "note"], ["1", "quoted\n" * 60], ["2", "3"]]
            with open(f"{folder}/{name}", "w", newline="", encoding="utf-8") as f:
                csv.writer(f, delimiter="," if name == "wide.csv" else ";").writerows(rows)
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = [sorted(map(str, df.collect())) for df in read_splits(spark, folder)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = [sorted(map(str, df.collect())) for df in read_delimited(spark, folder)]
    assert got == want
