"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from graphspark.llm import chat, jaccard, maxscore, mixing, orderhash, packing, ppm, quality, simhash, urlfilter, warc
from xxhash import xxh64_intdigest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy int, score double, part int"
LONG = "lorem ipsum dolor " * 60_000


def rows(extra: list[tuple] | None = None) -> list[tuple]:
    base = "one two three four five six seven eight nine ten"
    texts = [None, "", "   ", "word", "two words", base, base, base + " eleven", "Ünï cödé ß 🙂 text with  tabs\tand\nlines", base.upper(), LONG]
    out = [(i, t, "en", ("src0", "src1", None)[i % 3], None, 5, 0.5, 1) for i, t in enumerate(texts)]
    out += [out[5], (None, base, None, None, None, None, None, None), (3_000_000_000, "far id " * 30, "en", "zzz", 1, 1, 1.0, 1)]
    return out + (extra or [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1. Mixing

def test_mixing_counts_follow_the_inverted_distribution(spark, docs):
    weights = {"src0": 0.0002, "src1": 0.999}
    got = mixing.mix(docs, weights, others=0.0008).collect()
    rates = mixing.rates(docs, weights, 0.0008, 1.0, "source", "text")
    want = Counter()
    for doc_id, _, _, source, *_ in rows():
        u = (int(hashlib.sha256(f"{mixing.SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        rate, k, total = rates.get(source if source in weights else None, 0.0), 0, 0.0
        while rate > 0:
            total += math.exp(-rate) * rate**k / math.factorial(k)
            if u <= total:
                break
            k += 1
        want[doc_id] += k
    assert Counter(r.doc_id for r in got) == +want
    assert all(0 <= r.copy < r.n_copies for r in got)


def test_mixing_meets_its_targets(spark):
    many = spark.createDataFrame([(i, "x" * 100, "en", "src0" if i % 3 else "b", 0, 0, 0.0, 0) for i in range(6000)], SCHEMA)
    got = Counter(r.source for r in mixing.mix(many, {"src0": 0.25}, others=0.75).collect())
    assert abs(sum(got.values()) - 6000) < 400 and abs(got["src0"] / sum(got.values()) - 0.25) < 0.03


def test_mixing_empty_and_weightless(empty, docs):
    assert mixing.mix(empty).count() == 0
    assert {r.source for r in mixing.mix(docs, {"src0": 0.0, "src1": 0.999}, others=0.001).collect()} & {"src0"} == set()


def test_added_columns_clash_with_nothing(spark):
    table = spark.createDataFrame([(1, "a b c d", "src0", 1, 2, 3, 4, 5)], "doc_id long, text string, source string, _u int, _rank int, _keep int, _key int, _ID int")
    assert mixing.mix(table, {"src0": 1.0}, epochs=5.0).columns[:8] == table.columns
    for groups in (None, jaccard.similar_groups):
        assert simhash.keep_one_each(table, groups=groups).collect() == table.collect()


# 2. SimHash

def _print(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_prints_and_components(docs):
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows())
    texts = {r[0]: r[1] for r in rows()}
    for r in got:
        if r.doc_id != 10:
            assert r.fp & (2**64 - 1) == _print(texts[r.doc_id])
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[0] == by_id[1] == by_id[2] == 0 and by_id[5] == by_id[6] == by_id[9] == by_id[None] == 5


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks(2)
    assert all(any(not (m >> i & 1) and not (m >> j & 1) for m in masks) for i in range(64) for j in range(64))


@pytest.mark.parametrize("small", [True, False])
def test_near_pairs_keep_components(spark, monkeypatch, small):
    """Small buckets compare pairs, large ones meet at neighbours; both find brute force's components."""
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", 1000 if small else 1)
    draw = random.Random(3)
    prints = {draw.getrandbits(64) for _ in range(30)}
    for seed in list(prints)[:6]:
        for _ in range(25):
            seed ^= 1 << draw.randrange(64) if draw.random() < 0.7 else (1 << draw.randrange(64)) | (1 << draw.randrange(64))
            prints.add(seed)
    signed = sorted(simhash._signed(p) for p in prints)
    links = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"))
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
    from graphspark.llm.components import components

    found = {r.node: r.root for r in components(links).collect()}
    root = {p: p for p in signed}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert all(found.get(p, p) == top(p) for p in signed)


def test_components_of_a_long_chain(spark):
    from graphspark.llm.components import components

    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(chain).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100


def test_near_dedup_keeps_one(spark, docs, empty):
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 3, 4, 5, 7, 8, 10, 3_000_000_000]
    assert simhash.keep_one_each(empty).count() == 0 and simhash.simhash_components(empty).count() == 0


def test_near_dedup_keeps_every_group_whatever_the_ids(spark):
    texts = [f"{w} " * 3 + f"{w}a {w}b {w}c" for w in ("red", "blue", "green", "grey")]
    near = [(None, t) for t in texts[:2]] + [(None, texts[0]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (9, texts[2]), (None, texts[3]), (3, texts[1])]
    kept = simhash.keep_one_each(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, texts[0]), (3, texts[1]), (7, texts[2]), (7, texts[3])])
    # Upper case shares the fingerprint; of one id's, or no id's, texts in a group the smallest stays, null last.
    for key in (5, None):
        table = spark.createDataFrame([(key, "b c d"), (key, "B C D"), (key, None), (key, "")], "doc_id long, text string")
        assert {r.text for r in simhash.keep_one_each(table).collect()} == {"B C D", ""}


# 3. URL filters

def _judged(url):
    host, path = urlfilter.split_url(url)
    fits = [(t, a) for t, a in urlfilter.SITES if host and (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])]
    if fits:
        return max(fits, key=lambda r: len(r[0]))
    rules = urlfilter.rules_of([], urlfilter.PATTERNS)
    hit = [r for r in rules if r.expression.search(url or "")]
    best = next((r for r in hit if r.action == "allow"), None) or next((r for r in hit if r.action == "block"), None)
    return None, best.action if best else "allow"


def test_url_verdicts(spark):
    urls = [
        None, "", "no-scheme.com/en/1", "http://A.Example.COM/en/7", "https://example.com/en/8", "http://notexample.com/en/71?x", "http://x.net/de/81", "http://example.net/de/8#a",
        "http://example.org", "http://example.org?q=/es/", "http://shop.cheap-pills.example.org/fr/1", "http://a.b/ads", "http://a.b/xads/", "http://free-bets", "http://a.b/press/ads/x",
        "http://com/en/", "http://com:80/en/", "http://x.com/EN/1", "a://b://c/en/", "http://ünï.com/en/ü", "http://x.com/en/" + "y" * 100_000,
    ]
    table = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in urlfilter.filter_urls(table).collect()}
    for i, u in enumerate(urls):
        rule, verdict = _judged(u)
        assert (got[i].rule, got[i].verdict) == (rule, verdict), u
        assert (got[i].host, got[i].path) == urlfilter.split_url(u)
    assert max(r.n_checked for r in got.values()) < len(urlfilter.SITES) + len(urlfilter.PATTERNS)
    assert urlfilter.filter_urls(table.filter("false")).count() == 0


def test_site_rules_have_the_words_of_the_contract(spark):
    # The contract's list in full, not urlfilter.SITES: each rule by a URL that it alone decides or, as the longest, overrules another.
    wanted = [
        ("http://com/en/1", "com/en/", "block"), ("http://shop.example.com/en/8", "com/en/", "block"), ("http://example.com/en/7", "example.com/en/7", "allow"), ("http://a.example.com/en/71", "example.com/en/7", "allow"),
        ("http://net/de/", "net/de/", "allow"), ("http://x.net/de/81/ads/", "net/de/", "allow"), ("http://example.net/de/7", "net/de/", "allow"), ("http://example.net/de/8", "example.net/de/8", "block"),
        ("http://a.example.net/de/8/press/", "example.net/de/8", "block"), ("http://x.org/es/1", "org/es/", "block"), ("http://x.org/press/", None, "allow"), ("http://x.net/ads/", None, "block"),
    ]
    pages = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(wanted)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(pages).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(wanted)}


def test_rules_sit_under_their_rarest_token():
    rules = urlfilter.rules_of([("example.com/en/7", "allow")], [("*", "block"), ("^ads^", "block")])
    index = urlfilter.Index(rules, {"example": 90, "com": 100, "en": 5, "ads": 1})
    assert list(index.by_token) == ["en", "ads"] and index.always == [1]


# 4. MaxScore

def test_maxscore_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 60)
    monkeypatch.setattr(maxscore, "BLOCK", 3)
    monkeypatch.setattr(maxscore, "SEEDS", 8)
    draw = np.random.default_rng(5)
    vectors = {i: [float(np.float32(x)) for x in draw.normal(size=12) * (1 if i % 3 else 0.1)] for i in range(300)}
    vectors |= {7: vectors[6], 8: vectors[6], 11: None, 12: [1.0, None], 13: [float("nan")], 14: [float("inf")], 15: [], 16: [0.5], 100: [float(np.float32(3e38))] * 12, 150: [float(np.float32(2e5)), 1.0], 151: [float(np.float32(4e5))], 152: [float(np.float32(-3e6))] * 12}
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in vectors.items()] + [(None, [1.0], 0, 1), (50, vectors[50], 0, 1)], "vec_id long, embedding array<float>, label int, score int")
    from pyspark.sql import functions as F

    got = defaultdict(list)
    for r in maxscore.search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v in vectors.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in whole if i % 50 == 0):
        every = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q for _ in range(2 if i == 50 else 1)]
        assert got[q] == [(n, i, -s) for n, (s, i) in enumerate(sorted(every)[:5], 1)], q
    assert maxscore.search(table.filter("false"), F.lit(True)).count() == 0


def test_maxscore_of_large_components(spark):
    from pyspark.sql import functions as F

    for scale in (1.0, 3.0, 2.0**45, 2.0**1000):
        table = spark.createDataFrame([(0, [2e5, 1.0]), (1, [2e5, 0.0]), (2, [4e5 * scale, 0.0]), (3, [1.4e5, 0.0])], "vec_id long, embedding array<double>")
        got = maxscore.search(table, F.col("vec_id") == 0).orderBy("rank").collect()
        want = [(2, min((1 << 63) - 1, 5242880000000000 * int(scale))), (1, 2621440000000000), (3, 1835008000000000)]
        assert [(r.vec_id, r.score) for r in got] == want


# 5. Order MinHash

def test_order_minhash(spark, docs, empty):
    got = orderhash.edited_neighbours(docs).collect()
    assert len(got) == len(rows())
    ordered = sorted((r for r in rows() if r[0] is not None), key=lambda r: -r[0])
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    texts = {r[0]: r[1] or "" for r in rows()}
    ids = list(dict.fromkeys(r[0] for r in ordered))
    for i, doc_id in enumerate(ids):
        text, n = texts[doc_id], len(texts[doc_id])
        after = texts[ids[i + 1]] if i + 1 < len(ids) else texts[None]
        edited = text[: n - n // 3] + after[: n // 3]
        assert by_id[doc_id][-1].n_chars == n
        if doc_id != 5:  # it occurs twice, so that its own copy may follow it
            assert by_id[doc_id][0].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert by_id[5][0].fingerprint == by_id[6][0].fingerprint == by_id[None][0].fingerprint != by_id[7][0].fingerprint
    assert by_id[0][0].fingerprint == by_id[1][0].fingerprint == ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert orderhash.edited_neighbours(empty).count() == 0
    alone = orderhash.edited_neighbours(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def _order_minhash(text: str) -> dict[int, int]:
    """The hash of each class's ordered tuple, by brute force."""
    def signed(x: int, bits: int = 64) -> int:
        return x - (1 << bits) if x >> (bits - 1) else x

    def chained(*parts: bytes) -> int:
        seed = 42
        for part in parts:
            seed = xxh64_intdigest(part, seed)
        return signed(seed)

    words = []
    for w in re.split(r"[ \t\n\x0b\f\r]+", text):
        words += [c for c in w] if len(w) > orderhash.LONG_WORD else [w] if w else []
    low = (1 << orderhash.PLACE) - 1
    seen: Counter = Counter()
    classes = defaultdict(list)
    for i in range(max(1, len(words) - orderhash.K + 1) if words else 0):
        own = chained(*(w.encode() for w in words[i : i + orderhash.K])) >> orderhash.PLACE
        member = chained(own.to_bytes(8, "little", signed=True), seen[own].to_bytes(4, "little")) & ~low | i
        seen[own] += 1
        classes[member >> (64 - orderhash.CLASS_BITS)].append(member)
    out = {}
    for c, members in classes.items():
        mixed = 42
        for v in sorted(sorted(members)[: orderhash.PICKS], key=lambda v: v & low):
            mixed = chained(signed(mixed % (1 << 64)).to_bytes(8, "little", signed=True), (v >> orderhash.PLACE).to_bytes(8, "little", signed=True))
        out[c + orderhash.CLASSES // 2] = mixed & 0xFFFFFFFF
    return out


def test_order_minhash_equals_brute_force(spark, docs):
    def text_of(f):
        return "".join(f"{c:02x}{h:08x}" for c, h in sorted(f.items()))

    def likeness(a, b):
        return len(a.items() & b.items()) / len(a.keys() | b.keys()) if a or b else 1.0

    draw = random.Random(4)
    texts = [None, "", "a", "a b", "a a a a a a a", "long" * 500, "漢字" * 300 + " x", "é " * 40, *(" ".join(draw.choice("abcdefgh") * draw.randint(1, 30) for _ in range(draw.randint(1, 400))) for _ in range(30))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in orderhash.edited_neighbours(table).collect()}
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i - 1) % len(texts)] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other, of_edited = map(_order_minhash, (text, after, edited))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (text_of(own), text_of(of_edited)), i
        assert got[i].near_edited == pytest.approx(likeness(own, of_edited)) and got[i].near_next == pytest.approx(likeness(own, other))
    assert 0 < got[5].near_edited < 1


def test_order_minhash_sees_order(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    other = [f"v{i}" for i in range(400)]
    table = spark.createDataFrame([(3, " ".join(words)), (2, " ".join(moved)), (1, " ".join(other))], "doc_id long, text string")
    frame = orderhash.with_order_minhash(table, "text", "f")
    f = {r.doc_id: set(r.f) for r in frame.collect()}
    assert 0.2 < len(f[3] & f[2]) / 64 < 0.9 and not f[3] & f[1]


# 6. Packing

def test_packing_covers_every_id_once(spark, docs, empty):
    pieces = packing.pack(docs).orderBy("sequence_id", "offset").collect()
    at = 0
    for p in pieces:
        assert p.sequence_id * 2048 + p.offset == at and 0 < p.length <= 2048 and len(p.ids) == 4 * p.length
        at += p.length
    encode = packing.load_encoder(packing.default_encoder()[0], None, None)
    held = defaultdict(list)
    for p in pieces:
        held[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4")))
    for doc_id, text, *_ in rows():
        if doc_id not in (5, None):
            ids = np.concatenate([x for _, x in sorted(held[doc_id], key=lambda x: x[0])])
            assert list(ids) == [*encode(text or ""), 1]
    assert packing.pack(empty).count() == 0


def test_both_encoders_agree_on_every_code_point():
    slow, fast = packing.load_encoder(packing.default_encoder()[0], None, None), packing.load_encoder(*packing.default_encoder())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{c}b 1{c}2 {c}{c} .{c}\n" for c in points[at : at + 4096])
        assert list(slow(text)) == list(fast(text)), hex(ord(points[at]))
    assert list(slow("x<|endoftext|>y")) == list(fast("x<|endoftext|>y"))


def test_encoders_equal_an_unmodified_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_encoder()[0])
    encoders = packing.load_encoder(packing.default_encoder()[0], None, None), packing.load_encoder(*packing.default_encoder())
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}\n x", f"a  {end}  b\n\n{end}\n", f"<{end[:-1]}{end}>", " " * 1_000_000, f"x{end}" + "\n" * 1_000_000 + "y", f" {end}" + " " * 900_001 + f"{end} z"]
    for text in texts:
        want = plain.encode(text, add_special_tokens=False).ids
        for encode in encoders:
            assert encode(text).tolist() == want, (len(text), text[:40])
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_packing_survives_a_million_spaces(spark):
    table = spark.createDataFrame([(1, "x" + " " * 1_000_000 + "y"), (2, "a <|endoftext|> b")], "doc_id long, text string")
    encode = packing.load_encoder(packing.default_encoder()[0], None, None)
    assert sum(p.length for p in packing.pack(table).collect()) == len(encode("x" + " " * 1_000_000 + "y")) + 1 + 4 + 1


# 7. Language model

def _ppm_brute(training: list[str | None], order: int):
    counts: list[dict] = [defaultdict(Counter) for _ in range(order + 1)]
    for t in training:
        b = ppm.BEFORE * order + b" ".join(ppm.normal(t)) + ppm.END
        for i in range(order, len(b)):
            for j in range(order + 1):
                counts[j][b[i - j : i]][b[i]] += 1

    def logp(text: str | None) -> float:
        b, total = ppm.BEFORE * order + b" ".join(ppm.normal(text)) + ppm.END, 0.0
        for i in range(order, len(b)):
            excluded: set[int] = set()
            for j in range(order, -1, -1):
                live = {s: n for s, n in counts[j].get(b[i - j : i], {}).items() if s not in excluded}
                if not live:
                    continue
                if b[i] in live:
                    total += math.log10((live[b[i]] - 0.5) / sum(live.values()))
                    break
                total += math.log10(len(live) / 2 / sum(live.values()))
                excluded |= set(counts[j][b[i - j : i]])
            else:
                total -= math.log10(256 - len(excluded))
        return total

    return logp


@pytest.mark.parametrize("order, block, shards", [(ppm.ORDER, ppm.BLOCK, None), (3, 100, 3), (2, 7, 5), (0, 1 << 12, 2)])
def test_language_model(spark, docs, empty, monkeypatch, order, block, shards):
    """At the default order over every row; at others with blocks and shards so small that texts are cut."""
    if shards:
        monkeypatch.setattr(ppm, "SHARD_BYTES", 1)
        monkeypatch.setattr(ppm, "MOST_SHARDS", shards)
    small = docs if block > 1 << 20 else docs.filter("doc_id IS NULL OR doc_id <> 10")
    kept = [r for r in rows() if block > 1 << 20 or r[0] != 10]
    got = ppm.score(small, order=order, block=block).collect()
    assert len(got) == len(kept)

    def held(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0

    training = [r[1] for r in kept if not held(r[0])]
    words = Counter(w for t in training for w in ppm.normal(t))
    words["end"] = len(training)
    n, v = sum(words.values()), len(words)
    logp, texts = _ppm_brute(training, order), {r[0]: r[1] for r in kept}
    for r in got:
        tokens = [*ppm.normal(texts[r.doc_id]), "end"]
        assert r.held_out == held(r.doc_id) and r.n_tokens == len(tokens) and r.train_tokens == n
        assert r.n_known == sum(words[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
        assert r.score == pytest.approx(logp(texts[r.doc_id]))
    assert ppm.score(empty).count() == 0


def test_language_model_without_training(spark):
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = ppm.score(spark.createDataFrame([(lone, "ab c")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)]
    assert got[0].score == pytest.approx(-5 * math.log10(256)) and got[0].base_score == pytest.approx(3 * math.log10(0.1 / 0.1))


def test_trie_is_a_distribution():
    data = ppm.BEFORE * 3 + b"one two three one ten two" + ppm.END
    grams, n = np.unique(ppm.codes(data, 3), return_counts=True)
    low, m = np.unique(ppm.codes(data, 3) & np.uint64(0xFFFFFF), return_counts=True)
    trie = ppm.Trie.of(low, m, grams, n, 3)
    for context in (b"e t", b"zzz", b" on"):
        codes = np.array([int.from_bytes(bytes([s]) + context[::-1], "little") for s in range(256)], dtype=np.uint64)
        assert (10 ** trie.logs(codes)).sum() == pytest.approx(1.0, abs=1e-6)


# 8. Chat

@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "<\\|x", "<\\\\|<|", "a<", "|b", "<|im_start|>assistant\n<|im_end|>\n", "\\<|", "🙂<|é"])
def test_chat_round_trip(text):
    formatted, spans, _ = chat.format_turn("assistant", [{"type": "text", "text": text}])
    assert list(chat.parse_turns(formatted + chat.format_turn("us\\er\n<|", [])[0]))[0][:2] == ("assistant", text)
    assert "".join(chat.unescape(formatted[s["start"] : s["end"]]) for s in spans) == text
    assert next(chat.parse_turns(chat.format_turn("us\\er\n<|", [])[0]))[0] == "us\\er\n<|"


def test_chat_parts_and_attachments():
    blank = {"text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    parts = [
        blank | {"type": "text", "text": "see <"}, blank | {"type": "text", "text": "|x"}, blank | {"type": "image", "ref": "i1", "width": 29, "height": 28},
        blank | {"type": "audio", "ref": "a1", "seconds": 1.5}, blank | {"type": "document", "ref": "d1", "pages": 2}, blank | {"type": "text", "text": "<|image|>"},
    ]
    formatted, spans, attachments = chat.format_turn("assistant", parts)
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attachments] == [("image", "i1", 2), ("audio", "a1", 38), ("document", "d1", 512)]
    assert all(formatted[a["position"] :].startswith(f"<|{a['kind']}|>") for a in attachments)
    assert next(chat.parse_turns(formatted))[1] == "see <|x<|image|>" and len(spans) == 2


def test_chat_odd_parts():
    blank = {"text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    parts = [None, blank | {"type": "video", "ref": "v"}, blank | {"type": None}, *[blank | {"type": "audio", "seconds": x} for x in (math.nan, math.inf, -3.0, 1e300)], blank | {"type": "image", "width": -28, "height": 28}, blank | {"type": "document", "pages": -1}, None, blank | {"type": "text", "text": "t"}]
    formatted, spans, attachments = chat.format_turn("assistant", parts)
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attachments] == [("other", "v", 1), ("other", None, 1), *[("audio", None, 1)] * 3, ("audio", None, 25 << 53), ("image", None, 1), ("document", None, 1)]
    assert next(chat.parse_turns(formatted))[1] == "t" and len(spans) == 1


def test_chat_reading_back(spark):
    table = spark.createDataFrame(
        [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, None, None), (2, None, "assistant", None), (None, 5, "assistant", "<|"), (1, 1, "assistant", "b")],
        "conv_id long, turn long, role string, text string",
    )
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(table.withColumn("parts", chat.as_parts()))).collect()}
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(b"\n\nuser\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, hashlib.sha256(b"bb").hexdigest())
    assert got[None].loss_chars == 2 and got[2].loss_chars == 0
    assert chat.read_back(chat.format_turns(table.filter("false").withColumn("parts", chat.as_parts()))).count() == 0


# 9. WARC

def test_warc_round_trip(spark, tmp_path):
    pages = [(0, "http://a/\r\nX: y", "é" * 40_000), (1, None, None), (2, "u", ""), (3, "u", "same"), (9, "u", "same"), (4, "u", "same"), (4, "v", "same"), (5, "u", "WARC/1.1\r\n\r\n\r\n\r\n0\r\n\r\n"), (6, "u", "x" * 8192), (None, "u", "same"), (None, "u", "lone")]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, keeper int").repartition(3)
    warc.write_archives(table, f"{tmp_path}/w", segment=1000)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.read_archives(spark, f"{tmp_path}/w").collect())
    keeper = {}
    for i, _, h in pages:
        keeper[h or ""] = max(keeper.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        raw, k = (h or "").encode(), keeper[h or ""]
        answer = i == k or k == -1
        want.append((i is None, i or 0, len(raw), warc.base32_sha1(raw), "response" if answer else "revisit", 0 if answer else k))
    assert got == sorted(want)


def test_warc_records_are_named_and_dated(spark, tmp_path):
    table = spark.createDataFrame([(3, "u", "same"), (9, "u", "same"), (5, None, "other" * 20_000)], "page_id long, url string, html string")
    warc.write_archives(table, f"{tmp_path}/w")
    found = [h for f in tmp_path.glob("w/*.gz") for h, _ in warc.parse([f.read_bytes()])]
    names = [h["warc-record-id"] for h in found]
    assert len(set(names)) == len(names) == 6 and all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["warc-date"]) for h in found)
    revisit = next(h for h in found if h["warc-type"] == "revisit")
    assert revisit["warc-refers-to"] in names and warc._page(revisit["warc-refers-to"]) == 9


def test_warc_reading_checks_digests(spark, tmp_path):
    text = next(warc.records(1, "u", "abc", None, "0.0", "2026-01-01T00:00:00Z")).replace("abc", "abd") + "\r\n\r\n"
    (tmp_path / "a.warc").write_text(text, newline="")
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, f"{tmp_path}/a.warc").collect()


def test_warc_reads_other_archives(spark, tmp_path):
    """Plain files, several gzip members in a file, and pieces of any size fed to the parser."""
    page = [f"{r}\r\n\r\n".encode() for i in range(20) for r in warc.records(i, "u", f"{i}" * 300 + "\r\n\r\n", None, "0.0", "2026-01-01T00:00:00Z", 100)]
    (tmp_path / "a.warc").write_bytes(b"".join(page))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in page))
    for name in ("a.warc", "b.warc.gz"):
        got = warc.read_archives(spark, f"{tmp_path}/{name}").collect()
        assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, 300 * len(str(i)) + 4) for i in range(20)]
    whole = b"".join(page)
    for size in (1, 7, 1000):
        assert [b for _, b in warc.parse(whole[i : i + size] for i in range(0, len(whole), size))] == [b for _, b in warc.parse([whole])]


def test_warc_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.read_archives(spark, f"{tmp_path}/w").count() == 0


def test_segments_are_verified():
    assert warc.reassemble([2, 1], [4, None], [b"cd", b"ab"]) == b"abcd"
    with pytest.raises(ValueError):
        warc.reassemble([1, 3], [None, 4], [b"ab", b"cd"])
    with pytest.raises(ValueError):
        warc.reassemble([1, 2], [None, 5], [b"ab", b"cd"])
    assert warc.unchunked(b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"


# 10. Quality

def test_quality_over_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i != 10), 0) for i in range(11)] + [(None, 1, 0), (4, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.doc_id: r.held_out for r in got}[3] == (zlib.crc32(b"3") % 5 == 0)
    none = quality.learn(docs, labels.filter("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty, none).count() == 0 and quality.keep_good(docs, none).columns == docs.columns


def test_pairwise_fit_equals_newton():
    """The weights against Newton's method on the differences themselves."""
    draw = np.random.default_rng(2)
    z = draw.normal(size=(60, 4))
    better, worse = draw.integers(0, 30, 500), draw.integers(30, 60, 500)
    z[:30, 0] += 1
    w, d, ridge = np.zeros(4), z[better] - z[worse], 1e-2
    for _ in range(50):
        wins = 1 / (1 + np.exp(-(d @ w)))
        w -= np.linalg.solve((d.T * (wins * (1 - wins))) @ d / 500 + ridge * np.eye(4), d.T @ (wins - 1) / 500 + ridge * w)
    assert quality.fit(z, better, worse, ridge) == pytest.approx(w, abs=1e-3)


def test_quality_features_are_shares():
    texts = ["ab ab cd", None, "", "é" * 5, "x " * 3_000_000]
    x = quality.features(texts)
    assert x.shape == (5, quality.FEATURES) and np.isfinite(x).all() and not x[1:3].any()
    for row, text in zip(x[[0, 3, 4]], (texts[0], texts[3], texts[4])):
        words, grams = row[: quality.WORDS] ** 2, row[quality.WORDS : -quality.SHAPES] ** 2
        assert words.sum() == pytest.approx(1, abs=1e-3) and grams.sum() == pytest.approx(1, abs=1e-3)
        counts = Counter(zlib.crc32(w) % quality.WORDS for w in text.encode().split())
        assert all(words[k] == pytest.approx(n / sum(counts.values()), abs=1e-3) for k, n in counts.items())


def test_quality_learns_each_label_once(spark):
    texts = [(i % 7, "good clean prose of words " * 3 if i % 7 % 2 else "!!! BUY $$$ NOW " * 4) for i in range(700)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 3, "doc_id long, quality int")
    model = quality.learn(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    got = quality.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert {(r.doc_id % 2, r.predicted) for r in got} == {(0, 0), (1, 1)}


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.predicted) for r in quality.op10_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert len(judged) > 50 and sum(a == b for a, b in judged) / len(judged) > 0.97
