"""The pipeline's stages against brute force, each judged on its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline
from graphspark.llm import mixing, packing
from graphspark.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    """Each stage's input and output."""
    docs, found = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), f"test-{name}")
        found.append((docs, out))
        docs = out
    return found


def test_stages_keep_the_columns(outputs):
    for docs, out in outputs[:-1]:
        assert out.columns == docs.columns


def test_quality_keeps_good_documents(spark, outputs):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in outputs[0][1].collect()}
    assert all((d in kept) == bool(q) for d, q in labels.items())


def _similar_groups(texts: dict) -> set:
    """The smallest id of each group by brute force over five-word Jaccard similarity."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in words.items()}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {root(i) for i in sets}


def test_near_dedup_equals_brute_force_jaccard(spark, outputs):
    docs, out = outputs[1]
    rows = {r.doc_id: r.text for r in docs.collect()}
    base = " ".join(f"w{i}" for i in range(60))
    edits = [base, base.replace("w20 ", "x "), base.replace("w20 ", "x ").replace("w40 ", "y "), base.upper(), "", None, base[:100]]
    rows |= {1000 + i: t for i, t in enumerate(edits)}
    table_ = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows.items()], docs.schema)
    want = _similar_groups(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, table_, SF).collect()) == sorted(want)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i in want if i < 1000)


def test_mixing_and_packing(outputs):
    docs, out = outputs[2]
    assert out.count() == mixing.mix(docs).count() and {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
    pieces = outputs[3][1].collect()
    encode = packing.load_encoder(*packing.default_encoder())
    assert sum(p.length for p in pieces) == sum(len(encode(r.text)) + 1 for r in outputs[3][0].collect())


def test_stages_on_empty_tables(spark, outputs):
    docs = outputs[0][0].filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_simhash_proposes_pairs_in_the_stage(spark, outputs, monkeypatch):
    """Without any MinHash band, long texts with one word changed are still one group; far texts are not."""
    from graphspark.llm import jaccard, simhash

    base = " ".join(f"w{i}" for i in range(6000))
    texts = [base, base.replace("w900 ", "x "), base.replace("w4000 ", "y "), " ".join(f"v{i}" for i in range(6000)), "", "short"]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], outputs[1][0].schema)
    prints = [int(simhash.fingerprint(jaccard.shingles(t.encode(), 5))[0]) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS and (prints[0] ^ prints[2]).bit_count() <= simhash.RADIUS
    sketched = jaccard._sketched

    def without_bands(width):
        import pyarrow as pa

        def run(batches):
            for b in sketched(width)(batches):
                yield b.set_column(4, "bands", pa.array([[]] * b.num_rows, pa.list_(pa.int64())))

        return run

    monkeypatch.setattr(jaccard, "_sketched", without_bands)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, SF).collect()) == [0, 3, 4, 5]


def _edited(words: list[str], places: list[int], mark: str) -> list[str]:
    """words with those at `places` replaced by new ones."""
    out = list(words)
    for p in places:
        out[p] = f"{mark}x{p}"
    return out


@pytest.mark.parametrize("more", [False, True])
def test_edited_copies_of_one_text_are_not_all_compared(spark, outputs, monkeypatch, more):
    """Many edited copies, most similar but not similar enough: groups equal brute force. Where few texts share an edit, under a fifth of the pairs are judged."""
    import random

    from graphspark.llm import jaccard

    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    texts = [_edited(base, rng.sample(range(150), k % 12), f"t{k}") for k in range(360)]
    # Far from the base but near each other: by shingles that few have.
    for k in range(12):
        own = _edited(base, rng.sample(range(150), 9), f"u{k}")
        texts += [own, _edited(own, [k], f"v{k}"), _edited(own, [k + 70], f"z{k}")]
    # By shingles that many have.
    for k in range(2 * more):
        own = _edited(base, rng.sample(range(150), 9), f"many{k}")
        texts += [_edited(own, rng.sample(range(150), j % 5), f"m{k}j{j}") for j in range(30)]
    # Removed words leave only shingles that others have; shorter texts differ in size.
    if more:
        texts += [base[: 150 - 3 * k] for k in range(1, 14)] + [base[5 * k :] for k in range(1, 9)] + [base[: 20 * k] + base[20 * k + 12 :] for k in range(1, 7)]
    rng.shuffle(texts)
    rows = {i: " ".join(t) for i, t in enumerate(texts)}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows.items()], outputs[1][0].schema)
    judged, similar = spark.sparkContext.accumulator(0), jaccard._similar

    def counting(least):
        def run(batches):
            def seen():
                for batch in batches:
                    judged.add(batch.num_rows)
                    yield batch

            yield from similar(least)(seen())

        return run

    monkeypatch.setattr(jaccard, "_similar", counting)
    want = _similar_groups(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == sorted(want)
    assert 100 < len(want) < len(texts) - 100 and judged.value > 0
    if not more:
        assert judged.value < len(texts) ** 2 // 10, (judged.value, len(texts))
