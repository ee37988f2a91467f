"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, and empty tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import common, components, decontamination, extraction, licenses, mixing, oracle, quality, queries, simhash, syncmers, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int, vocab: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocab)}{'é' if rng.random() < 0.2 else ''}" for _ in range(n)]


def text(n: int, seed: int) -> str:
    return " ".join(words(n, seed))


@pytest.fixture(scope="module")
def rows():
    near = words(200, 5)
    near2 = near[:100] + ["CHANGED"] + near[101:]
    made = [
        (0, text(120, 1), "en", "a", 0),
        (1, text(120, 1), "en", "a", 0),  # exact copy
        (2, " ".join(near), "en", "b", 0),
        (3, " ".join(near2), "en", "b", 0),  # near copy
        (4, None, "en", "b", 0),
        (5, "", "en", None, 0),
        (6, "one", "en", None, 0),
        (7, "Two  WORDS\n", "en", "c", 0),
        (8, text(5000, 9), "en", "c", 0),  # long
        (9, text(60, 10) + " " + text(30, 77).replace("w", "W") + " tail.", "de", "c", 0),
        (9, text(60, 10) + " " + text(30, 77).replace("w", "W") + " tail.", "de", "c", 0),  # repeated row
        (10, "a b c d", "en", "a", 0),
        (11, "###*** !!! $$$", "en", "d", 0),
        (None, text(50, 3), "en", "d", 0),
    ]
    return made + [(100 + i, text(40 + i, 200 + i), "en", "abcd"[i % 4], 0) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return common.materialize(spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash")).repartition(3), "docs")


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def by_row(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# 1 ---------------------------------------------------------------------------------------------------------


def page_rows():
    return [(0, "http://a/x y", "<p>é</p>"), (1, "http://a/", "<p>é</p>"), (1, "http://a/", "<p>é</p>"), (2, None, None),
            (3, "http://b/", ""), (4, "http://c/", "x" * 300_000), (None, "http://d/", "<p>é</p>"), (5, "http://e/", "HTTP/1.1 200\r\n\r\nWARC/1.1\n\n")]


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").repartition(3)
    found = warc.pages_through_archives(pages, version=version).collect()
    assert len(found) == len(page_rows())
    want = sorted(
        ((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in page_rows()), key=repr
    )
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in found), key=repr) == want
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in found), key=repr)
    assert kinds == sorted([(0, "response", None), (1, "revisit", 0), (1, "revisit", 0), (2, "response", None), (3, "revisit", 2),
                            (4, "response", None), (None, "revisit", 0), (5, "response", None)], key=repr)
    assert len({r.record_id for r in found}) == len(found)


def test_archives_of_no_pages(spark):
    assert warc.pages_through_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_arc_headers_and_lengths():
    for version in (1, 2):
        block = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\nhttp://not.a.header 1 2 3 4\n"
        data = warc.arc_filedesc("x.arc", "20010203040506", version) + warc.arc_record(block, "http://x/ y", "1.2.3.4", "20010203040506", "text/html", version)
        data += warc.arc_record(b"dns answer", "dns:x", "1.2.3.4", "2001", "text/dns", version)
        first, page, dns = warc.read_arc(data)
        assert (first["version"], page["block"], page["url"], page["ip"]) == (version, block, "http://x/%20y", "1.2.3.4")
        made = [warc.arc_to_warc(r, "x.arc") for r in (first, page, dns)]
        assert [m["type"] for m in made] == ["warcinfo", "response", "resource"]
        assert made[1]["date"] == "2001-02-03T04:05:06Z" and made[2]["date"] == "2001-01-01T00:00:00Z"
        assert made[1]["payload"].startswith(b"body") and len({m["id"] for m in made}) == 3
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-5]))
    with pytest.raises(ValueError):
        list(warc.read_arc(b"http://x 1 2 3 4\nabcd"))


# 2 ---------------------------------------------------------------------------------------------------------


def brute_hits(text_, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text_ or ""))
    hit, own = set(), set()
    for i, t in items:
        p = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for a in range(max(1, len(p) - 9)) if p else []:
            n = min(10, len(p))
            for b in range(len(w) - n + 1):
                if w[b : b + n] == p[a : a + n]:
                    hit.update(range(b, b + n))
                    own.add(i)
    return len(w), len(hit), own


def brute_spans(text_, hit):
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text_ or ""))]
    runs = [(i, j) for i in hit if i - 1 not in hit for j in hit if j >= i and j + 1 not in hit and all(k in hit for k in range(i, j))]
    return [(at[i][0], at[j][1]) for i, j in runs]


@pytest.mark.parametrize("block", [decontamination.BLOCK_CHARS, 300])
def test_decontamination(spark, docs, rows, block):
    items = [(1, text(30, 77)), (2, "One"), (3, text(120, 1)[:200]), (4, None), (5, "?!"), (6, "a-B c"), (6, "a-B c"), (None, "two words")]
    bench = spark.createDataFrame([(None if i is None else str(i), t) for i, t in items], "item_id string, text string")
    found = decontamination.scan(docs, bench, keep=["doc_id", "text"], block_chars=block, prefix="s_").collect()
    assert len(found) == len(rows)
    for r in found:
        n, hit, own = brute_hits(r.text, items)
        assert (r.s_n_words or 0, len(r.s_hit_words), r.s_item_ids) == (n, hit, sorted(str(i) for i in own - {None}) + [None] * (None in own))
        assert [tuple(s) for s in r.s_spans] == brute_spans(r.text, r.s_hit_words)
        for s in r.s_spans:
            assert 0 <= s.start < s.end <= len(r.text)
        if r.doc_id == 9:
            assert any(r.text[s.start : s.end].startswith(text(30, 77).replace("w", "W")[:20]) for s in r.s_spans)


def test_decontamination_of_nothing(spark, docs, rows, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.scan(no_docs, none).count() == 0
    assert {len(r.hit_words) for r in decontamination.scan(docs, none).collect()} == {0}


# 3 ---------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, docs, rows, no_docs):
    found = syncmers.fingerprints(docs).collect()
    assert len(found) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    following = [*texts[1:], texts[0]]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
    want = sorted(((r[0], len(t), hashlib.sha256(e.encode()).hexdigest()) for r, t, e in zip(order, texts, edited, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr) == want
    one = {r.doc_id: r for r in found}
    assert one[0].fingerprint == one[1].fingerprint and one[0].near_next == 1.0
    assert one[2].near_next > 0.8 and one[8].near_edited > 0.2 and one[100].near_next < 0.05
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert syncmers.fingerprints(no_docs).count() == 0


def brute_anchors(t):
    """Words, with each letter of unspaced scripts a word; hashes as Spark's xxhash64 chains them."""
    unspaced = "[\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff]"
    w = [x for x in re.split(rf"[\x20\x09-\x0D]+|(?<={unspaced})|(?={unspaced})", t or "") if x]
    one = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    h = [one(x.encode(), 42) for x in w]

    def chain(values):
        seed = 42
        for v in values:
            seed = one(v.to_bytes(8, "little"), seed)
        return seed >> 32

    signed = [v - (1 << 64) if v >> 63 else v for v in h]
    if len(h) < 3:
        return {chain(h)} if h else set()
    return {chain(h[i : i + 3]) for i in range(len(h) - 2) if min(signed[i], signed[i + 2]) <= signed[i + 1]}


def brute_likeness(a, b):
    sketch = lambda x: sorted(x)[: max(64, len(x) // 4)]
    p, q = sketch(a), sketch(b)
    known = [len(x) for x in (p, q) if len(x) >= 64]
    union = sorted(set(p) | set(q))[: min(known, default=None)]
    return sum(x in p and x in q for x in union) / len(union) if union else 1.0


def test_fingerprints_against_brute_force(spark):
    han = "".join(chr(0x4E00 + i * 37 % 2000) for i in range(361))
    made = [text(900, 1), text(900, 1) + " and more", text(500, 2), han, han[:-1] + "末", "สวัสดี ครับ", "", None, "one", "one two", "Mixed 漢字 and words " + text(70, 4), text(3000, 7)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string").withColumn("sketch", F.lit("clash"))
    found = {r.doc_id: r for r in syncmers.fingerprints(table).collect()}
    texts = [t or "" for t in made]
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, changed, other = brute_anchors(t), brute_anchors(edited), brute_anchors(following)
        assert found[i].fingerprint == "".join(f"{v:08x}" for v in sorted(own)[: max(64, len(own) // 4)])
        assert found[i].edited_fingerprint == "".join(f"{v:08x}" for v in sorted(changed)[: max(64, len(changed) // 4)])
        assert math.isclose(found[i].near_edited, brute_likeness(own, changed)) and math.isclose(found[i].near_next, brute_likeness(own, other))
    assert found[3].near_next > 0.95 and found[3].near_edited > 0.2


def test_anchors_are_closed_syncmers(spark):
    t = text(300, 12)
    df = spark.createDataFrame([(t,)], "text string").select(syncmers.anchors(F.col("text")).alias("a"), syncmers.word_hashes(F.col("text")).alias("h"))
    a, h = df.first()
    assert [x.pos for x in a] == [i for i in range(len(h) - 2) if min(h[i : i + 3]) in (h[i], h[i + 2])]
    shifted = spark.createDataFrame([("x y z " + t,)], "text string").select(syncmers.anchors(F.col("text")).alias("a")).first()[0]
    assert [(x.pos, x.hash) for x in a] == [(x.pos - 3, x.hash) for x in shifted if x.pos >= 3]


def test_one_document_follows_itself(spark):
    only = spark.createDataFrame([(7, "a b c d", "en", "a", 7)], DOCS)
    r = syncmers.fingerprints(only).first()
    assert r.edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b"[:3]).hexdigest() and r.near_next == 1.0


# 4 ---------------------------------------------------------------------------------------------------------


def test_quality_learns(spark):
    rng = random.Random(4)
    good = [(i, ". ".join(text(20, 1000 + i + j).capitalize() for j in range(5))) for i in range(150)]
    bad = [(1000 + i, rng.choice(["word " * 60, " | ".join(words(50, i)), text(50, i).upper(), text(40, i).replace(" ", "### ")])) for i in range(150)]
    docs = spark.createDataFrame([(*r, "en", "a", 0) for r in good + bad + [(5000, None), (5001, "")]], DOCS)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad] + [(5000, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, training=F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i, _ in good + bad if i % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i < 1000) for i in held]) > 0.95
    assert got[5000] == got[5001] and 0 <= got[5000] <= 1
    again = quality.train(docs.repartition(5), labels, training=F.col("doc_id") % 3 != 1)
    assert all((a == b).all() for a, b in zip(model["tables"], again["tables"], strict=True)) and model["pairs"]


def test_quality_without_labels(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert {r.score for r in quality.score(docs, model, name="_q", keep=docs.columns).select(F.col("_q").alias("score")).collect()} == {0.5}
    assert quality.score(no_docs, model).count() == 0


def test_table_entries_add_up():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(400, len(quality.FEATURES)))
    y = ((X[:, 0] > 0) ^ (X[:, 1] > 0)).astype(float)  # only an interaction tells
    model = quality.fit(X, y, rounds=20)
    assert ((quality.scores(model, X) >= 0.5) == y).mean() > 0.9 and any(p[:2] == (0, 1) for p in model["pairs"])


# 5 ---------------------------------------------------------------------------------------------------------


def brute_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 3 * total[s]}
        target |= {s: 3 * total[s] for s in full} if full else {s: level * weight[s] for s in open_}
        left -= sum(3 * total[s] for s in full)
        open_ = open_ - full if full else set()
    return size, total, target


def test_mix(docs, rows, no_docs):
    size, total, target = brute_mix(rows)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    taken = dict.fromkeys(total, 0)
    for r in found:
        assert r.source_size == total[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
        assert r.epochs * r.size <= r.taken <= min(3, r.epochs + 1) * r.size
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 1
        partial = [r for r in found if r.source == s and r.epochs * r.size < r.taken < (r.epochs + 1) * r.size]
        assert len(partial) <= 1
        more = [r.key for r in found if r.source == s and r.taken == (r.epochs + 1) * r.size and r.size]
        less = [r.key for r in found if r.source == s and r.taken == r.epochs * r.size and r.size]
        assert not more or not less or max(more) <= min(less)  # smallest keys first
    assert by_row(mixing.mix(docs.repartition(7)), "doc_id", "taken") == by_row(mixing.mix(docs), "doc_id", "taken")
    assert mixing.mix(no_docs).count() == 0


def test_mix_by_given_weights(spark):
    """Heavier documents come first more often; null and tiny weights are held; rows without ids have keys of their own."""
    made = [(None if i % 2 else i, " ".join(["w"] * 10) + f" {i}", "a" if i < 400 else "b", [0.9, 0.02, None, -1.0][i % 4]) for i in range(800)]
    table = spark.createDataFrame(made, "doc_id long, text string, source string, w double")
    found = mixing.mix(table, weights=(1, 9), weight=F.col("w")).collect()
    assert len(found) == 800 and len({r.key for r in found}) == 800
    rest = [r for r in found if r.source == "a" and r.taken > r.epochs * r.size]
    heavy = sum(r.doc_id is not None and r.doc_id % 4 == 0 for r in rest)
    assert len(rest) > 50 and heavy > 0.8 * min(100, len(rest))


# 6 ---------------------------------------------------------------------------------------------------------


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    fps, root = [f for _, f in pairs], list(range(len(pairs)))
    for i, j in itertools.combinations(range(len(pairs)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    return [min((pairs[j][0] for j in range(len(pairs)) if root[j] == root[i] and pairs[j][0] is not None), default=None) for i in range(len(pairs))]


def test_simhash(docs, rows, no_docs):
    prints = simhash.fingerprints(docs)
    assert by_row(prints, "doc_id", "fp") == sorted(((r[0], int(np.uint64(brute_print(r[1])).astype(np.int64))) for r in rows), key=repr)
    pairs = [(r[0], brute_print(r[1])) for r in rows]
    want = sorted(zip([r[0] for r in rows], brute_components(pairs), strict=True), key=repr)
    assert by_row(simhash.near_duplicates(common.materialize(prints, "p")), "doc_id", "component_id") == want
    assert simhash.near_duplicates(simhash.fingerprints(no_docs)).count() == 0


@pytest.mark.parametrize("tile", [7, 40, 4096])
def test_tiles_lose_no_link(spark, tile):
    rng = random.Random(tile)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base[:6]:  # chains and clusters; also many that share a band
        for _ in range(30):
            fps.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 5))))
    fps |= {rng.getrandbits(48) for _ in range(60)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    prints = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long").repartition(4)
    links = simhash.fingerprint_links(prints, tile=tile)
    for a, b in by_row(links, "a", "b"):
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    roots = {r.node: r.root for r in components.connected_components(links).collect()}
    want = brute_components(list(enumerate(fps)))
    groups = {}
    for s, w in zip(signed, want, strict=True):
        groups.setdefault(roots.get(s, s), set()).add(w)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_dense_tile_is_folded(monkeypatch):
    monkeypatch.setattr(simhash, "LINKS", 50)
    fps = np.array([0b111 << i for i in range(40)] + [1 << i for i in range(40)] + [(1 << 63) - 1], np.uint64)
    a, b = simhash.tile_links(fps, None, step=8)
    assert set(a.tolist()) | set(b.tolist()) == set(fps[:-1].tolist()) and len(a) == len(fps) - 2  # one tree, but for the last


def test_pipeline_drops_all_near_copies(spark, tmp_path, monkeypatch):
    """Every pair of a Jaccard of 0.8 or more on 5-word shingles is linked, none below; brute force over all pairs."""
    import corpus_pipeline
    from ledgerlens.llm import neardup

    rng, made = random.Random(4), []
    for base in range(25):
        own = words(rng.randrange(1, 200), 900 + base, 5000)
        for _ in range(6):
            made.append(" ".join(w if rng.random() > 0.015 else f"x{rng.random()}" for w in own))
    hub = words(100, 77, 5000)
    made += [" ".join(hub[:i] + ["new"] + hub[i + 1 :]) for i in range(0, 100, 2)]  # many alike
    made += [None, "", " ", "one", "ONE", "two words", "a a a a a a a", "a a a a a"]
    own = words(300, 5, 9000)
    for cut in range(0, 31):  # sets on both sides of 0.8
        made.append(" ".join(own[:270] + [f"c{cut}.{i}" for i in range(cut)]))
    cut = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())((t or "").lower().split())
    sets = [cut(t) for t in made]
    root = list(range(len(made)))
    for i, j in itertools.combinations(range(len(made)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    table = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(made)], DOCS).repartition(3)
    table = common.materialize(table, "docs")
    kept = corpus_pipeline.drop_near_duplicates(spark, table, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    rng = np.random.default_rng(2)  # no pair shares more than its signatures allow, also with buckets of 255 and more
    for n, m, of in ((300, 250, 400), (90_000, 80_000, 100_000), (5, 0, 10), (1, 1, 1)):
        a, b = (np.unique(rng.permutation(of)[:k]) * 257 + 5 for k in (n, m))
        raw = [np.frombuffer(neardup.signature(x.astype(np.int64)), np.uint8)[None] for x in (a, b)]
        most = neardup.most_shared(*raw, np.array([len(a)]), np.array([len(b)]))[0]
        assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
        counts = neardup.read_marks(np.array([neardup.marks(x.astype(np.int64)) for x in (a, b)], object))
        assert len(np.intersect1d(a, b)) <= neardup.most_shared(counts[:1], counts[1:], np.array([len(a)]), np.array([len(b)]))[0] <= min(len(a), len(b))
    monkeypatch.setattr(neardup, "COMMON_SEEN", 1)  # another order, the same links
    got = {r.doc_id: r.component_id for r in neardup.near_copies(table).collect()}
    assert got == dict(enumerate(root))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (200, None)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------

URLS = [
    (0, "http://A.Example.NET/en/1?x", None), (1, "https://net/", ""), (2, "https://x.org/fr/2", "<p>"), (3, "no scheme", None), (4, None, None),
    (5, "http://shop.com/a", '<link rel="canonical" href="http://bad.net/z">'), (6, "http://other.com/b#f", "<META http-equiv=refresh content='0; url=http://shop.com/a'>"),
    (7, "http://x.org/fr/9", '<link href="http://shop.com/a" rel=canonical>'), (8, "http://a?b", None), (9, "x://h#://q/de/", None), (9, "x://h#://q/de/", None),
    (10, "http://example.com/de/q", None), (11, "http://badexample.com/de/q", None), (12, "http://example.net/fr/", None),
]


@pytest.mark.parametrize("inline", [256, 0])
def test_urls(spark, inline, monkeypatch):
    monkeypatch.setattr(urlfilter, "with_rules", lambda u, r, f=urlfilter.with_rules: f(u, r, inline))
    pages = spark.createDataFrame(URLS, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1] == ("net", "/", "net/", "block")
    assert got[2][2:] == ("org/fr/", "allow") and got[3] == got[4] == ("", "", None, "allow")
    assert got[5][2:] == (None, "block") and got[6][2:] == (None, "block") and got[7][2:] == ("org/fr/", "allow")
    assert got[8][:2] == ("a", "") and got[9] == ("h", "", None, "allow")
    assert got[10][3] == "block" and got[11][3] == "allow" and got[12][3] == "block"
    assert urlfilter.judge(pages, rules).count() == len(URLS)
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, rules.limit(0), pages.limit(0).selectExpr("url a", "url b")).collect()} == {"allow"}


def test_urls_against_sql(spark, tmp_path):
    import duckdb

    from ledgerlens.llm import oracle

    more = [(20, "http://chain.com/1", '<link rel="canonical" href="/2">'), (21, "http://chain.com/2", '<link rel=canonical href="//chain.com/3">'),
            (22, "http://chain.com/3#x", '<meta http-equiv="refresh" content="0;url=http://a.net/?a=1&amp;b=2">'), (23, "relative", '<link rel=canonical href="/x">'),
            (24, "http://alone.com/", '<link rel=canonical href="/">'), (25, "http://free.com/1", '<link rel=canonical href="/2">')]
    spark.createDataFrame(URLS + more, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = by_row(queries.op7_urlfilter(spark, str(tmp_path)), "page_id", "host", "path", "rule", "verdict")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.sql(f"select page_id, host, path, rule, verdict from ({oracle.OP7}) q").fetchall(), key=repr)
    verdicts = {r[0]: r[4] for r in got}
    assert [verdicts[i] for i in range(20, 26)] == ["block", "block", "block", "allow", "allow", "allow"]


def test_all_links_of_a_page_count(spark):
    bad = "http://bad.net/x/"
    pages = [(0, "http://a.com/d/p.html", '<link rel="canonical" href="b.html">'), (1, "HTTP://A.com/d/b.html", f'<meta http-equiv="refresh" content="0;url={bad}">'),
             (2, "http://c.com/d/e/p", '<link rel=canonical href="../q?x=1">'), (3, "http://c.com/d/q?x=1", f"<link rel='canonical' href='{bad}'>"),
             (4, "http://e.com/p", '<link rel=canonical href="?id=2">'), (5, "http://e.com/p?id=2", f'<link rel="canonical" href="/"><link rel="nofollow canonical" href="{bad}">'),
             (6, "http://f.com/a/p", f"<meta http-equiv=refresh content='1;url=next'><meta http-equiv=refresh content='1;url={bad}'>"), (7, "http://f.com/a/next", ""),
             (8, "http://g.com/", '<link rel="stylesheet" href="http://bad.net/x/"><link rel="canonical-not" href="http://bad.net/x/">'), (9, "relative", '<link rel=canonical href="b?u=http://bad.net/x/">')]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(table, rules).collect()}
    assert got == {i: "block" if i < 8 else "allow" for i in range(10)}
    paths = spark.createDataFrame([("/a/./b/../c",), ("/a/..",), ("/../../x",), ("/a/b/.",), ("/a.b/..c",)], "p string")
    assert [r[0] for r in paths.select(urlfilter.without_dots(F.col("p"))).collect()] == ["/a/c", "/", "/x", "/a/b/", "/a.b/..c"]


# 8 ---------------------------------------------------------------------------------------------------------


def brute_licenses(t, templates):
    split = lambda x: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").lower()) if w]
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    w, own = split(t), set()
    for name, template in templates:
        s = cut(split(template))
        n = licenses.window_size(len(s))
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        if any(len(s & set(grams[a : a + n])) >= 0.8 * len(s) for a in range(0, max(1, len(grams)), n // 2)):
            own.add(name)
    return sorted(own)


def test_licenses(spark, docs, no_docs):
    long = licenses.NOTICES[4][1]
    given = [(0, text(80, 1) + "\n" + licenses.NOTICES[1][1] + "\n" + text(50, 2)), (1, long + " " + text(10, 4)), (2, None), (3, ""), (4, "mit license"),
             (5, text(90, 3) + " " + long.replace("software", "thing", 1) + text(30, 5)), (6, (text(7, 1) + " released UNDER the mit-license! ") * 40),
             (7, " ".join(long.split()[::-1])), (8, "Licensed under the Apache License, Version 2.0. " + licenses.NOTICES[2][1])]
    df = spark.createDataFrame(given, "doc_id long, text string").withColumn("licenses", F.lit("clash"))
    full = dict(licenses.TEMPLATES[-15:])
    given += [(20 + i, text(33 + i, i) + "\n# " + t.replace(" ", "\n# ", 40) + "\n" + text(70, i + 1)) for i, t in enumerate(full.values())]
    given += [(60, " ".join(full.values())), (61, full["zlib"][: len(full["zlib"]) // 2]), (62, full["bsd-2-clause"].replace("DAMAGES", "LOSSES"))]
    df = spark.createDataFrame(given, "doc_id long, text string").withColumn("licenses", F.lit("clash"))
    many = [(f"own-{i}", text(5 + 4 * (i % 20), 1000 + i)) for i in range(200)] + [("none", ""), ("null", None)]
    listed = spark.createDataFrame([*many, *licenses.TEMPLATES], "license string, text string").withColumn("_hits", F.lit(1))
    given_many = df.union(spark.createDataFrame([(100 + i, text(20, i) + " " + t + " " + t[:60]) for i, (_, t) in enumerate(many[:40])], "doc_id long, text string").withColumn("licenses", F.lit("")))
    got_many = {r.doc_id: r.licenses for r in licenses.scan(given_many, listed).collect()}
    assert got_many == {r.doc_id: brute_licenses(r.text, [t for t in [*many, *licenses.TEMPLATES] if t[1]]) for r in given_many.collect()}
    assert all(f"own-{i}" in got_many[100 + i] for i in range(40))
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert got == {i: brute_licenses(t, licenses.TEMPLATES) for i, t in given}
    assert all(name in got[20 + i] for i, name in enumerate(full)) and "zlib" not in got[61] and "bsd-2-clause" in got[62]
    got = {r.doc_id: r.licenses for r in licenses.scan(df, licenses.NOTICES).collect()}
    assert got == {i: brute_licenses(t, licenses.NOTICES) for i, t in given}
    assert got[0] == ["cc-by-nc-4.0"] and got[6] == ["mit"] and got[8] == ["apache-2.0", "gpl-3.0"] and got[7] == []
    assert licenses.scan(no_docs).count() == 0 and licenses.scan(df, []).select(F.size("licenses")).distinct().collect()[0][0] == 0


# 10 --------------------------------------------------------------------------------------------------------


def brute_cut(gain, edges):
    best = None
    for side in itertools.product([False, True], repeat=len(gain)):
        cost = sum(max(g, 0) for g, s in zip(gain, side, strict=True) if not s) + sum(max(-g, 0) for g, s in zip(gain, side, strict=True) if s)
        cost += sum(c for i, j, c in edges if side[i] != side[j])
        best = min(best or (cost, 99, side), (cost, sum(side), side))
    return best


def test_minimum_cut():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 8)
        gain = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(0, 7)) for _ in range(rng.randrange(0, 12))]
        cost, size, _ = brute_cut(gain, edges)
        side = hmm_side = extraction.min_cut(gain, edges)
        own = sum(max(g, 0) for g, s in zip(gain, side, strict=True) if not s) + sum(max(-g, 0) for g, s in zip(gain, side, strict=True) if s)
        own += sum(c for i, j, c in edges if side[i] != side[j])
        assert (own, sum(hmm_side)) == (cost, size)


PAGE = """<!DOCTYPE html><html><head><title>Title &amp; more</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site"><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of all kinds, every day.</a></li></ul></nav><!-- <p>x</p> -->
<div class="cookie-notice"><p>We use cookies on this site to do many things that you may not like.</p></div>
<article><h1>Heading&nbsp;one &eacute;</h1><p>First   paragraph
of the text, with <b>bold</b> and <a href="x">a link</a> in it.<p>Second one<br>goes on.</p><p>No.</p><ul><li>item one</li><li>item two</li></ul>
<div class="ad">Buy the things now, they are good and cheap, for you.</div><p>Last paragraph of this page &lt;here&gt;.</p>
<section id="comments"><h3>Comments</h3><p>I think that this is a very good text, thank you so much for it.</p></section></article>
<aside class="sidebar"><p>Other texts that you should read, because they are good.</p></aside><form><p>Your name, please, and your address.</p><input name=q></form>
<footer>&copy; Site &middot; All rights reserved, and so on, in many words."""


def test_main_text(spark):
    want = "Heading one é\nFirst paragraph of the text, with bold and a link in it.\nSecond one goes on.\nNo.\nitem one\nitem two\nLast paragraph of this page <here>."
    rows = [(0, "u", PAGE), (1, "u", None), (2, None, ""), (3, "u", "<nav><a href=x>only links</a></nav>"), (0, "u", PAGE), (4, "u", "<article><p>" + "long text. " * 30000)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert [r.text for r in got if r.page_id == 0] == [want, want]
    assert {r.page_id: r.text for r in got if r.page_id in (1, 2, 3)} == {1: "", 2: "", 3: ""}
    assert all(r.n_chars == len(r.text) for r in got) and next(r for r in got if r.page_id == 4).n_chars == 30000 * 11 - 1
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "There are many words in this passage, and all of them are about the same thing as before. " * 5


@pytest.mark.parametrize(("page", "want"), [
    ('<body class="single has-sidebar sidebar-right"><article class="post tag-social"><p>Body text of the page.</p></article></body>', "Body text of the page."),
    ('<article><div class="entry-header"><h1>Head</h1></div><p>One sentence.</p></article>', "Head\nOne sentence."),
    (f'<article><p>Start.</p><p class="notice">{LONG}</p><p>End.</p></article>', "Start.\nEnd."),
    (f'<article><p>Start.</p><p>{LONG}</p></article><section id="readerComments"><div><p>{LONG}</p></div></section>', f"Start.\n{LONG.strip()}"),
    (f'<article><p>Start.</p></article><article class="comment"><p>{LONG}</p></article>', "Start."),
    ('<article><p>See:</p><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></article>', "See:\none\ntwo"),
    (f'<div class="siteHeader"><p>{LONG}</p></div><div id="main-content"><p>This is what the page says.</p><table><tr><td>a</td><td>b c</td></tr></table></div>',
     "This is what the page says.\na\nb c"),
    (f'<div role="contentinfo"><p>{LONG}</p></div><p>This is what the page says.</p><p>And so on it goes.</p>', "This is what the page says.\nAnd so on it goes."),
    (f'<div class="x1"><p>{LONG}</p></div><article><p>Only this one.</p></article>', "Only this one."),
    ('<article><p>x < y &lt;b&gt; <math><mi>z</mi></math></p></article>', "x < y <b> z"),
    (f'<div class="topnav">{LONG}</div><div class="pagecontent"><h1>Head</h1><p>{LONG}</p></div><div class="adbox">{LONG}</div>'
     f'<div class="cookiebar">{LONG}</div><div class="usercomments"><p>{LONG}</p></div><div class="pagefooter">{LONG}</div>', f"Head\n{LONG.strip()}"),
    (f'<div class="wrapper sidebar-layout"><main><h1>Head</h1><p>{LONG}</p></main></div>', f"Head\n{LONG.strip()}"),
    (f'<h1>The head of it</h1><div itemprop="articleBody"><p>{LONG}</p><p>Yes.</p></div><div class="x1">{LONG[:90]}</div>', f"The head of it\n{LONG.strip()}\nYes."),
    ('<article><div class="commentary"><p>A commentary is a text of its own.</p></div></article>', "A commentary is a text of its own."),
])
def test_main_text_of_other_layouts(page, want):
    assert extraction.main_text(page.encode()) == want


def test_main_text_of_articles_in_layouts():
    long = "A paragraph of the article that says a good deal about its subject, and goes on to say some more of it."
    for around in ("wrapper sidebar-layout", "content-with-sidebar"):
        assert extraction.main_text(f"<body><div class='{around}'><article><p>{long}</p></article></div></body>".encode()) == long
    for name in ("discussion", "search", "menu", "navigation", "replies"):
        page = f"<article><p>{long}</p><section id='{name}'><h2 id='related-work'>Related work</h2><p>{long}</p></section></article>"
        assert extraction.main_text(page.encode()) == f"{long}\nRelated work\n{long}"
    other = f"<main><p>{long}</p></main><div class='comments'><article><p>{long}</p></article></div><aside><article><p>{long}</p></article></aside>"
    assert extraction.main_text(other.encode()) == long


@pytest.mark.parametrize("piece", ['<a "', "<a ", "<script ", "<!", "</b>", "<b>", "<p>x</p>y<b>", "<div>x", "<a href='", '<p class="', "<!--", "<textarea>", "&", '<i title=">">x</i>'])
def test_broken_pages_take_linear_time(piece):
    """A megabyte of open quotes, tags, comments or end tags, after which text is still read or belongs to the open part."""
    for page in (piece * (1_000_000 // len(piece)), "<div><i>" * 20_000 + piece * (500_000 // len(piece))):
        start = time.process_time()
        found = extraction.blocks_of(page + " the end")
        assert time.process_time() - start < 6 and isinstance(found, list)


def test_quotes_that_never_close():
    assert [b["text"] for b in extraction.blocks_of('<p title="a > b">one</p><p class="x>two</p><p>three "four"</p>')] == ["one", "two", 'three "four"']
    assert [b["text"] for b in extraction.blocks_of("<p>a < b and <c</p>")] == ["a < b and"]
    assert [b["text"] for b in extraction.blocks_of("<p>1 <2 x")] == ["1 <2 x"]
    assert [b["text"] for b in extraction.blocks_of("<p>x<y z")] == ["x<y z"]


def test_minimum_cut_of_many_blocks():
    rng = random.Random(2)
    n = 20_000
    gain = [rng.randrange(-900, 900) for _ in range(n)]
    side = extraction.min_cut(gain, [(i, i + 1, 400) for i in range(n - 1)])
    best = [(0, 0)]  # least cost of each side, along the chain
    for g in gain:
        a, b = best[-1] if len(best) > 1 else (0, 0)
        step = 400 if len(best) > 1 else 0
        best.append((min(a, b + step) + max(-g, 0), min(b, a + step) + max(g, 0)))
    cost = sum(max(-g, 0) if s else max(g, 0) for g, s in zip(gain, side, strict=True)) + 400 * sum(a != b for a, b in itertools.pairwise(side))
    assert cost == min(best[-1])


# all -------------------------------------------------------------------------------------------------------


def test_ordered_index(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(0).sample(range(1000), 300)], "x int").repartition(7)
    got = common.ordered_index(df, ["x"], "i").orderBy("x").collect()
    assert [r.i for r in got] == list(range(300))


def test_pipeline_keeps_unlike_rows_of_one_id(spark):
    """Rows are documents: ids shared or missing, and columns with the names that the stages use."""
    import corpus_pipeline

    unlike, copy = text(40, 1), text(40, 2)
    made = [(1, unlike, "1"), (1, copy, "2"), (2, copy, "3"), (None, copy, "4"), (None, text(40, 3), "5"), (None, text(40, 3), "6"), (None, None, "7"), (7, "", "8")]
    table = spark.createDataFrame(made, "doc_id long, text string, row string")
    for name in ("key", "_row", "signature", "prefix", "scan_hit_words", "quality_score", "n"):
        table = table.withColumn(name, F.lit("clash"))
    kept = corpus_pipeline.drop_near_duplicates(spark, table, "")
    assert kept.columns == table.columns
    found = {(r.doc_id, r.row) for r in kept.collect()}
    assert (1, "1") in found and (1, "2") in found and (7, "8") in found and len(found) == 4 and found & {(None, "5"), (None, "6")}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = text(15, 900)
    clean = [(i, ". ".join(text(15, 3000 + 7 * i + j).capitalize() for j in range(6)), "en", "ab"[i % 2], 0, "extra") for i in range(120)]
    junk = [(1000 + i, "spam " * (40 + i), "en", "a", 0, "x") for i in range(60)]
    copies = [(2000 + i, clean[5][1], "en", "b", 0, "x") for i in range(9)] + [clean[6]]
    leaks = [(3000, clean[7][1] + " " + item + " " + clean[8][1], "en", "a", 0, "x")]
    given = spark.createDataFrame(clean + junk + copies + leaks, DOCS + ", size string")
    given.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(100)] + [(1000 + i, 0, 0) for i in range(50)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = given, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == given.columns
        seen.append(sorted(r.doc_id for r in docs.collect()))
    assert not set(seen[0]) & {r[0] for r in junk} and {r[0] for r in clean} <= set(seen[0])
    assert seen[1] == sorted({*(r[0] for r in clean), 3000}) and seen[2] == [r[0] for r in clean]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == seen[2]
    empty = given.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op2_decontamination", "op8_licenses"])
def test_queries_against_sql(spark, tmp_path, name):
    import duckdb

    item, notices = text(23, 7), [t for _, t in licenses.NOTICES]
    docs = [(0, None), (1, ""), (2, "one two"), (3, item), (4, text(60, 2) + " " + re.sub("[a-z]", lambda m: m[0].upper(), item).replace(" ", " -- ") + " " + text(9, 3)), (5, "Yes, it is so."),
            (6, "it is"), (7, " ".join(item.split()[3:14]) + " x " + " ".join(item.split()[4:12])), (8, text(40, 1) + " " + " ".join(notices)),
            (9, (notices[4] + " \n ") * 30), (10, " ".join(notices[5].split()[:-3])), (11, " ".join(notices[5].split()[:-8])), (12, "straße É " + item + " ÉTÉ")]
    items = [(1, item), (2, None), (3, "!!"), (4, "it is so"), (10, text(10, 1)), (1, item), (11, "straße é " + " ".join(item.split()[:8]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    found = queries.QUERIES[name](spark, str(tmp_path))
    want = con.execute(oracle.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(want.fetchall())
    assert {r[0] for r in found.where("contaminated" if name.startswith("op2") else "n_licenses > 0").select("doc_id").collect()} >= ({3, 4, 5, 7, 12} if name.startswith("op2") else {8, 9, 10})


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
