"""Operators against brute force on small tables with odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataloom.llm import bpe, embeddings, langid, matching, packing, pii, quality, simhash, substrings, suffixes, warc

PASSAGE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t ", "one", "Hello world it's don't <|endoftext|> x", PASSAGE, "before " + PASSAGE + " after", PASSAGE, "zz " + PASSAGE[:150],
    "ab" * 4000, " ".join(f"k{i % 977}" for i in range(30000)), "Étion à la ÉTÉ ΣΑΣ.\nline\nline\n\n", "mail a.b@c.org or +1 (555) 555-1234, 10.0.0.255 and 4111 1111 1111 1111.",
    "x@y.z@q.r 1.2.3.4.5 999.1.1.1 +12", "same words here again same words here again same words here again", "a b\x1cc  d",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 1, "extra") for i, t in enumerate(TEXTS)] + [(5, PASSAGE, "en", "s", 1, "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def words(t):
    return (t or "").encode().split()


def test_bpe(docs, empty):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    for r in bpe.encode_decode(docs, path, output="full").collect():
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty, path).count() == 0


def test_packing(docs, empty):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(path)
    rows, by, seq = packing.pack(docs, path).collect(), defaultdict(list), defaultdict(list)
    want = [t.encode(x or "", add_special_tokens=False).ids + [1] for x in TEXTS]
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
        part = want[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert all(sum(r.length for r in by[d]) == len(w) * (2 if d == 5 else 1) for d, w in enumerate(want))
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(empty, path).count() == 0


def test_substrings(docs, empty):
    first = {}
    for d, t in enumerate(TEXTS):
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for r in substrings.dedup(docs).collect():
        w = words(TEXTS[r.doc_id])
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < r.doc_id:
                gone[i : i + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert substrings.dedup(empty).count() == 0
    stripped = substrings.strip(docs)
    assert stripped.columns == docs.columns and stripped.count() == docs.count()


@pytest.mark.parametrize("hot", [suffixes.HOT, 0])
def test_suffixes(docs, empty, hot, monkeypatch):
    monkeypatch.setattr(matching, "BUCKET_BYTES", 20_000 if hot else 1 << 20)
    first = {}
    for d, t in enumerate(TEXTS):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for r in suffixes.dedup(docs, hot=hot).collect():
        b = (TEXTS[r.doc_id] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < r.doc_id:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())
    assert suffixes.dedup(empty).count() == 0


def test_simhash(docs, empty):
    def fp(t):
        w = words((t or "").encode().lower().decode())
        shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    prints = [fp(t) for t in TEXTS]
    label = list(range(len(TEXTS)))
    for _ in label:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    for r in simhash.components(docs).select("*", simhash.hex_digits().alias("x")).collect():
        assert (int(r.x, 16), r.component_id) == (prints[r.doc_id], label[r.doc_id])
    assert simhash.components(empty).count() == 0
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(label) - {label[0]} | {0}


def test_near_finds_all_pairs():
    random = np.random.default_rng(1)
    base = random.integers(0, 1 << 63, 300).astype(np.uint64)
    fps = np.concatenate([base, base ^ np.uint64(0b1011), base ^ np.uint64(0b11111)])
    a, b = simhash.near(fps, np.array([0, len(fps)]))
    assert len(b) == 600  # of each three, the first two are linked, and the last two


def test_embeddings(spark):
    random = np.random.default_rng(3)
    x = random.standard_normal((200, 16)).astype(np.float32)
    x[50:90] = x[:40] + 0.1 * random.standard_normal((40, 16)).astype(np.float32)
    x[90:120] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] * 16)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    links = near.sum(1) - 1
    assert len(got) == 204 and all(got[i].n_links == 0 and got[i].kept for i in range(200, 204))
    assert all(got[i].n_links <= links[i] for i in range(200)) and sum(got[i].n_links for i in range(200)) >= 0.95 * links.sum()


def test_warc(spark):
    big, small = "é" * 700, "x" * 500
    rows = [(1, "http://a/b c", big), (2, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", big), (6, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.read(warc.write(pages), with_html=True).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter(
        [(1, "revisit", 6, 1400), (2, "revisit", 6, 1400), (3, "response", None, 500), (4, "response", None, 500), (5, "response", None, 0), (6, "response", None, 1400), (6, "response", None, 1400)]
    )
    assert all(r.payload_digest == hashlib.sha1((rows[r.page_id - 1][2] or "").encode()).hexdigest() for r in got)
    assert warc.read(warc.write(pages.filter("false"))).count() == 0


def test_pii(docs, empty):
    got = {r.doc_id: r for r in pii.find(docs, pii.fit(docs)).collect()}
    r = got[12]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.spans.startswith("email:5:")
    assert got[0].spans == "" and pii.find(empty, pii.fit(empty)).count() == 0
    assert "a.b@c.org" not in pii.redact(docs, pii.fit(docs)).filter("doc_id = 12").first().text


def test_quality(docs, empty):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert got[0].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[14].base_failed and got[14].n_repeat_words == 12 and got[11].n_dup_lines == 1 and got[5].kept
    assert quality.judge(empty, labels).count() == 0
    assert quality.binomial_tail(0, 100, 0.05) == pytest.approx(0.95**100)
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)


def test_language(docs, empty):
    model = langid.fit(docs, F.lit(True))
    got = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    assert got[0].lang_pred == got[2].lang_pred == "und" and got[5].lang_pred == "en" and 0 <= got[5].score <= 1
    assert langid.fit(empty, F.lit(True)) is None
    assert langid.predict(docs, None, ["doc_id"]).filter("lang_pred <> 'und'").count() == 0
