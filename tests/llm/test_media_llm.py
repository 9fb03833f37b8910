"""Ogg pages: checksum, lacing, streams, damage; and the queries and pipeline as a whole."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

import pytest

from veilspan.llm import ogg, simhash
from veilspan.llm.queries import oracle_sql, queries, tokenizer_path

SF = "/root/testdata/sf0.001"


def slow_checksum(page):
    crc = 0
    for b in page:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for n in (0, 1, 27, 300):
        page = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert ogg.page_checksum(page) == slow_checksum(page)


@pytest.mark.parametrize("sizes", [[0], [255], [254, 255, 256, 0], [70_000, 3, 65_025, 510], [1] * 600])
def test_packets_round_trip(sizes):
    packets = [bytes(random.Random(i).randrange(256) for _ in range(n)) for i, n in enumerate(sizes)]
    pages = ogg.paginate(packets, list(range(len(sizes))), 5, 0, ogg.FIRST | ogg.LAST)
    (s,), bad = ogg.demux(b"junk" + b"".join(pages))
    assert s.packets == packets and not bad and not s.gaps and s.pages == len(pages) and s.first and s.last
    assert s.granules[-1] == len(sizes) - 1


def test_every_packet_has_its_own_time(spark):
    """Packets that end on one page: each ends where its own samples end."""
    samples = ogg.text_payload(b"x" * 100_000)
    (a, note), bad = ogg.demux(ogg.mux_samples(samples, b"n_bytes=100000"))
    ends = [min(len(samples), k * ogg.PACKET) for k in range(1, -(-len(samples) // ogg.PACKET) + 1)]
    assert a.granules == [0, *ends] and note.granules == [0, 1] and not bad
    df = spark.createDataFrame([(1, bytearray(ogg.mux_samples(samples, b"n_bytes=100000")))], "doc_id long, media binary")
    got = ogg.media_packets(df).filter("seconds is not null").orderBy("packet").collect()
    assert [r["seconds"] for r in got] == [0, *(e / ogg.RATE for e in ends)] and b"".join(bytes(r["data"]) for r in got[1:]) == samples
    unknown = ogg.paginate([b"head"], [0], 9, 0, ogg.FIRST) + ogg.paginate([b"a", b"b"], [5, 7], 9, 1, ogg.LAST)
    assert ogg.demux(b"".join(unknown))[0][0].granules == [0, -1, 7]


def test_damage_is_seen():
    samples = ogg.text_payload(b"x" * 200_000)
    data = bytearray(ogg.mux_samples(samples, b"n_bytes=200000"))
    good, _ = ogg.demux(bytes(data))
    assert ogg.samples_of(good) == samples and len(good) == 2
    at = data.find(b"OggS", len(data) // 2)
    data[at + 40] ^= 1
    streams, bad = ogg.demux(bytes(data))
    assert bad >= 1 and sum(s.gaps for s in streams) == 1 and ogg.samples_of(streams) != samples
    assert ogg.demux(b"") == ([], 0) and ogg.demux(b"OggS")[1] == 1


def test_media_columns(spark):
    texts = [None, "", "a" * 576, "é" * 400, "z" * 300_000, "a" * 576]
    df = spark.createDataFrame([(i, t, "m", "f") for i, t in enumerate(texts)], "doc_id long, text string, media string, feature string")
    media = ogg.with_media(df)
    rows = {r["doc_id"]: r for r in ogg.media_features(media).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert rows[2][1:] == rows[5][1:] and "ms=72" in rows[2]["feature"]
    packets = [r for r in ogg.media_packets(media).collect() if r["doc_id"] == 4]
    assert max(r["seconds"] or 0 for r in packets) == pytest.approx(len(ogg.text_payload(b"z" * 300_000)) / 8000)
    odd = spark.createDataFrame([(1, None), (2, b"nope")], "doc_id long, media binary")
    assert [r["payload_bytes"] for r in ogg.media_features(odd).orderBy("doc_id").collect()] == [None, None] and ogg.media_packets(odd).count() == 0
    assert ogg.media_features(media.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_matches_sql(spark, duck, same, name):
    same(queries()[name](spark, SF), duck, oracle_sql()[name])


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")) == list(range(1, 11))


def brute_pipeline(rows):
    """Ids that each of the first three stages keeps, by plain loops."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spoken = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    last = {}
    for i, t in spoken:
        last[t.translate(fold)] = max(i, last.get(t.translate(fold), i))
    exact = [(i, t) for i, t in spoken if last[t.translate(fold)] == i]
    up = {i: i for i, _ in exact}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    fps = [(i, simhash.fingerprint(t.encode())) for i, t in exact]
    for k, (i, a) in enumerate(fps):
        for j, b in fps[:k]:
            if (a ^ b).bit_count() <= 2:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i for i, _ in spoken}, {i for i, _ in exact}, {i for i in up if root(i) == i}


def test_pipeline_stages(spark):
    """Each stage on all that the one before kept, against brute force."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer
    from veilspan.llm.common import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, kept, texts = docs.columns, [], [docs.select("doc_id", "text").collect()]
    for name, f in p.STAGES[:-1]:
        docs = stage(f(spark, docs, SF), name)
        assert docs.columns == cols
        texts.append(docs.select("doc_id", "text").collect())
        kept.append({r["doc_id"] for r in texts[-1]})
        assert len(kept[-1]) == len(texts[-1]) > 0
    spoken, exact, near = brute_pipeline([tuple(r) for r in texts[0]])
    # A document without a main language may go as well; none of one language does.
    assert kept[0] <= spoken and len(kept[0]) >= 0.95 * len(spoken)
    _, exact, near = brute_pipeline([tuple(r) for r in texts[1]])
    assert kept[1] == exact and kept[2] == near and kept[3] <= near
    n_tokens = lambda rows: sum(len(re.findall("[^ \t\n\x0b\f\r]+", r["text"] or "")) for r in rows)
    before = {r["doc_id"]: r["text"] for r in texts[3]}
    assert n_tokens(texts[4]) == n_tokens(texts[3]) * 3 // 4 and all(before[r["doc_id"]].startswith(r["text"]) for r in texts[4])
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out = {r["doc_id"]: tuple(r)[1:] for r in p.STAGES[-1][1](spark, docs, SF).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in texts[4]:
        ids = t.encode(r["text"], add_special_tokens=False).ids
        assert out.pop(r["doc_id"]) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.decode(ids, skip_special_tokens=False).encode()))
    assert not out


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No rows; and only nulls, empty texts, repeats and columns of clashing names."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert p.run(spark, f"{tmp_path}/none").count() == 0
    words = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(None, words, "en", None, 1, "x", "y"), (1, None, None, "s1", None, None, "y"), (2, "", "en", "s1", 0, "x", "y"), (3, words.upper(), "en", "s1", 1, "x", "y"), (3, words, "en", "s1", 1, "x", "y")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, _row string")
    for name, f in p.STAGES[:-1]:
        odd = f(spark, odd, SF)
        assert odd.columns == ["doc_id", "text", "lang", "source", "n_chars", "_id", "_row"]
    assert odd.select("doc_id").collect() == [(3,)]
