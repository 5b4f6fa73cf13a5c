import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seriesforge.llm import divergence, filter_audit, warc
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n int, term string, mask int, part string, g int"
LABELS = "doc_id long, quality int, toxic int, lang string"


def corpus(n, sources, words, seed=5):
    """Documents whose words are shared by all, some or one of the sources, with nulls and repeats."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice([*sources, None, ""])
        pool = [f"w{'abcdefghij'[k % 10] * (1 + k // 10)}" for k in range(words)] + [f"Own{s}É", "Ω", "x"]
        text = " ".join(rng.choice(pool) + rng.choice(["", "", "1", "'s", "|"]) for _ in range(rng.randrange(0, 300)))
        rows.append((i if i % 17 else None, rng.choice([text, text, text, None, "", "THE SAME " * 120]), rng.choice(["en", "en", "de", None]), s, 1, "t", 3, "p", 9))
    return rows + rows[:5]


@pytest.mark.parametrize("cost, most, tile, stripe", [(8, 512, 1 << 18, 256), (10**6, 512, 40, 2), (0, 3, 1 << 18, 256), (0, 512, 64, 3)])
def test_divergence_equals_brute_force(spark, cost, most, tile, stripe):
    """Whichever terms are light or heavy, and however tiles are cut, the sums are the same."""
    rows = corpus(150, ["s1", "s2", "s3", "é", "z"], 40)
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(tuple(r) for r in divergence.divergence(docs, 7, pair_cost=cost, most_postings=most, tile=tile, stripe=stripe).collect())
    assert got == brute.divergence([(r[2], r[3], r[1]) for r in rows], top=7)


def test_divergence_of_odd_tables(spark):
    docs = spark.createDataFrame(corpus(1, ["s"], 3), DOCS)
    assert divergence.divergence(docs.limit(0)).collect() == []
    few = [(1, "a b", "en", "x", 1, None, None, None, None), (2, "c", "en", "y", 1, None, None, None, None), (3, "ö" * 3_000_000 + " b", "de", "x", 1, None, None, None, None)]
    got = sorted(tuple(r) for r in divergence.divergence(spark.createDataFrame(few, DOCS)).collect())
    assert got == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]  # no term is kept


def test_divergence_pieces_cut_no_term():
    text = "ab ,cde1fgh" * 50
    assert [t for p in divergence.pieces(text, 7) for t in divergence.TERM.findall(p)] == divergence.TERM.findall(text)
    assert "".join(divergence.pieces(text, 7)) == text


def test_filter_audit_equals_brute_force(spark):
    rows = corpus(120, ["s1", "s2"], 300)
    labels = [(i % 130, i % 2, i % 3 % 2, "x") for i in range(90)] + [(None, 1, 1, "x"), (3, 1, None, "x"), (4, None, 1, "x"), (9999, 1, 1, "x")]
    counts = filter_audit.cells(filter_audit.masked(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(labels, LABELS))
    got = sorted(tuple(r) for r in filter_audit.audit(counts).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())
    assert got == brute.filter_audit([(r[0], r[2], r[1]) for r in rows], labels)


def test_filter_audit_of_an_empty_table(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(filter_audit.cells(filter_audit.masked(docs), labels)).collect() == []


PAGES = "page_id long, url string, html string, payload string, id string, uri int"
LONG = "<p>é</p>" * 400


@pytest.fixture()
def pages(spark):
    rows = [(1, "http://a/ b\r\nX: y", LONG, "k", "k", 1), (2, None, LONG, None, None, None), (3, "u", None, None, None, None), (4, "u", "", None, None, None), (5, "é", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 60, None, None, None)]
    rows += [(6, "u", "short", None, None, None), (7, "u", "short", None, None, None), (7, "u", LONG, None, None, None), (7, "v", LONG, None, None, None), (None, "u", LONG, None, None, None), (None, "u", "z" * 2000, None, None, None), (None, "u", "z" * 2000, None, None, None), (8, "u", "x" * 300_000, None, None, None)]
    return spark.createDataFrame(rows, PAGES)


def by_row(records):
    return sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers) for r in records.select("*", warc.row_of("record_id").alias("id"), warc.row_of("refers_to").alias("refers")).collect()), key=str)


def test_archives_read_back(spark, pages, tmp_path):
    names = warc.write_archives(pages, f"file://{tmp_path}/out", "page_id", "url", "html", records_per_file=3)
    assert sorted(f.name for f in tmp_path.glob("out/*.warc.gz")) == names and len(names) >= 4
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    out = warc.read_archives(spark, f"file://{tmp_path}/out")
    assert out.where("kind = 'gap'").count() == 0
    want = []
    for r in pages.collect():
        data = (r.html or "").encode()
        refers = "7" if r.html == LONG and r.page_id != 7 else None
        want.append((None if r.page_id is None else str(r.page_id), len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers))
    assert by_row(out) == sorted(want, key=str)
    assert {bytes(r.payload).decode() for r in out.where("record_type = 'response'").collect()} == {r.html or "" for r in pages.collect()}
    assert out.where("uri = 'http://a/%20b%0D%0AX:%20y'").count() == 1
    # the members are ordinary gzip, and together an ordinary WARC stream
    plain = b"".join(gzip.decompress((tmp_path / "out" / n).read_bytes()) for n in names)
    assert plain.startswith(b"WARC/1.1\r\n") and [r["kind"] for r in warc.salvaged(plain)] == ["record"] * 13
    with pytest.raises(FileExistsError):
        warc.write_archives(pages, f"file://{tmp_path}/out", "page_id", "url", "html")


def test_an_empty_table_gives_no_records(spark, pages, tmp_path):
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none", "page_id", "url", "html")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").collect() == []


def records(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = rng.randbytes(rng.randrange(0, 3000)) + b"WARC/1.1\r\n\r\n" * (i % 3)
        out.append(warc.record(str(i), f"http://h/{i}", body, len(body), hashlib.sha1(body).digest(), None, "2020-01-01T00:00:00Z"))
    return out


def found(data):
    rows = list(warc.salvaged(data))
    return [r["record_id"] for r in rows if r["kind"] == "record"], [(r["offset"], r["length"]) for r in rows if r["kind"] == "gap"]


@pytest.mark.parametrize("packed", [False, True])
def test_damage_costs_only_the_records_that_it_meets(packed):
    """Bytes changed, lost or added anywhere: all untouched records come back, and records and gaps
    together cover every byte once."""
    parts = [gzip.compress(r, mtime=0) if packed else r for r in records(9)]
    ids = [f"<urn:row:{i}>" for i in range(9)]
    assert found(b"".join(parts)) == (ids, [])
    starts = [sum(map(len, parts[:k])) for k in range(10)]
    rng = random.Random(2)
    for trial in range(60):
        hit = rng.randrange(9)
        at = rng.randrange(len(parts[hit]))
        broken = bytearray(parts[hit])
        if trial % 3 == 0:
            broken[at] ^= 1 + rng.randrange(255)
        elif trial % 3 == 1:
            del broken[at : at + 1 + rng.randrange(50)]
        else:
            broken[at:at] = rng.randbytes(1 + rng.randrange(50))
        data = b"".join(parts[:hit]) + bytes(broken) + b"".join(parts[hit + 1 :])
        rows = list(warc.salvaged(data))
        got = [r["record_id"] for r in rows if r["kind"] == "record"]
        assert [i for i in got if i in ids and i != ids[hit]] == [i for i in ids if i != ids[hit]], (trial, hit, at)
        for r in rows:
            if r["kind"] == "gap":
                assert starts[hit] <= r["offset"] and r["offset"] + r["length"] <= starts[hit] + len(broken)


def test_gaps_are_logged_with_their_bytes():
    a, b, c = (gzip.compress(r, mtime=0) for r in records(3))
    noise = b"\x1f\x8b\x08 not a member \nWARC/1.1\r\nnor a record"
    assert found(noise + a + noise + b + c[:-9]) == (["<urn:row:0>", "<urn:row:1>"], [(0, len(noise)), (len(noise) + len(a), len(noise)), (2 * len(noise) + len(a) + len(b), len(c) - 9)])
    assert found(b"") == ([], []) and found(b"\r\n") == ([], [(0, 2)])
    # a member of several records, one of them damaged, and plain records between members
    x, y, z = records(3)
    many = gzip.compress(x + y.replace(b"http", b"hxtp").replace(b"HTTP/1.1 200", b"HTTP/1.1 500") + z, mtime=0)
    rows = list(warc.salvaged(many + x))
    assert [(r["kind"], r["offset"], r.get("inner_offset")) for r in rows] == [("record", 0, 0), ("gap", 0, len(x)), ("record", 0, len(x) + len(y)), ("record", len(many), None)]


def test_damaged_files_in_a_folder(spark, pages, tmp_path):
    names = warc.write_archives(pages, f"file://{tmp_path}/out", "page_id", "url", "html", records_per_file=4)
    file = Path(tmp_path, "out", names[0])
    data = bytearray(file.read_bytes())
    data[40] ^= 255
    file.write_bytes(bytes(data))
    file.with_name(f".{file.name}.crc").unlink()  # of Hadoop's local file system, which would refuse the file
    out = warc.read_archives(spark, f"file://{tmp_path}/out")
    gaps = out.where("kind = 'gap'").collect()
    assert len(gaps) == 1 and gaps[0].path.endswith(names[0]) and gaps[0].offset == 0
    assert out.where(F.col("kind") == "record").count() == pages.count() - 1
