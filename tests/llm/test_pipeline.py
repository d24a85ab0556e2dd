"""The pipeline's stages on a small corpus, each against what it is to keep."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from pointloom.llm import packing, simhash, verify
from tests.llm.test_operators import edited, lines_by_brute_force, prose


def mixed_by_brute_force(rows, epochs=3):
    """How often each row is taken: sources' shares by weight, clamped one after another; whole repetitions, then rows in seeded order while half of one fits."""
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    target, free, left = {}, set(sources), sum(total.values())
    while free:
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > epochs * total[s]}
        if not over:
            target |= share
            break
        target |= {s: Fraction(epochs * total[s]) for s in over}
        free, left = free - over, left - sum(epochs * total[s] for s in over)
    out = Counter()
    for s in sources:
        whole = target[s] // total[s] if total[s] else 0
        rest = target[s] - whole * total[s]
        mine = sorted(((i, t) for i, t, x in rows if x == s), key=lambda r: (hashlib.md5(f"mix-1|{'' if r[0] is None else r[0]}".encode()).hexdigest(), size(r[1])))
        before = 0
        for i, t in mine:
            n = min(epochs, int(whole) + (size(t) > 0 and 2 * (rest - before) >= size(t)))
            before += size(t)
            if n:
                out[i, t, s] += n
    return out


def packed_by_brute_force(rows):
    """The pieces of each text's ids, by the tokenizer and the binary digits of their number."""
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    out = Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        start = 0
        while start < len(ids):
            length = min(4096, 1 << ((len(ids) - start).bit_length() - 1))
            out[i, start, length, zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length])), len(ids)] += 1
            start += length
    return out


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    texts = ["\n".join(prose(100 + 10 * i + k, rng.randrange(8, 40)) for k in range(3)) for i in range(60)]
    texts += [texts[0], edited(texts[1].replace("\n", " "), 5, 2), "", None, "12345 6789"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [k for k, _ in pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "packing"]
    seen = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, seen, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        before = {r.doc_id: r.text for r in seen.select("doc_id", "text").collect()}
        if k < 4:
            assert tuple(out.columns) == pipeline.COLUMNS
            after = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
        if name == "language ID":
            assert set(before) - set(after) == {62, 63, 64}
        elif name == "line dedup":
            want = {i: t for i, t in lines_by_brute_force(sorted(before.items())).items() if t.strip()}
            assert after == want
        elif name == "SimHash near-dedup":
            ids = sorted(before)
            sets = {i: simhash.shingle_set(before[i]) for i in ids}
            near = {j for a, i in enumerate(ids) for j in ids[a + 1 :] if verify.jaccard(sets[i], sets[j], 0.8)}
            assert set(after) == set(ids) - near
        elif name == "mixing":
            rows = [(r.doc_id, r.text, r.source) for r in seen.collect()]
            got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
            assert got == mixed_by_brute_force(rows) and max(got.values()) <= 3
        else:
            got = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out.collect())
            assert got == packed_by_brute_force([(r.doc_id, r.text) for r in seen.collect()])
        seen = out
    assert np.array_equal(np.sort(pipeline.run(spark, str(tmp_path)).toPandas().ids_crc32), np.sort(seen.toPandas().ids_crc32))


def test_stages_on_awkward_tables(spark):
    """Nulls in every column, repeated rows, empty and long texts, clashing columns; and no rows at all."""
    text = prose(1, 60)
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (None, text, None, None, None), (2, None, "en", None, 0), (3, "", "de", "b", 0), (None, None, None, None, None), (4, prose(2, 4000), "de", "b", 9), (5, "x", "en", "a", 1)]
    rows += [(10 + i, prose(50 + i, 30), ("en", "de")[i % 2], "a", 9) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.select("*", *[docs.text.alias(c) for c in ("id", "item", "bucket", "key", "th", "t", "size", "copies", "rank", "score", "__keep_", "ids")])
    for name, stage in pipeline.STAGES:
        out = stage(spark, clash, "").toPandas()
        if name == "packing":
            assert len(out[out.start == 0]) == len(rows)
        else:
            assert tuple(out.columns) == pipeline.COLUMNS
            texts = out.text.dropna().tolist()
            assert len(texts) == 0 or set(t for t in texts if t) <= {t for _, t, *_ in rows if t}
        if name == "SimHash near-dedup":
            assert sum(t == text for t in texts) == 1 and len(out) == len(rows) - 2
        assert stage(spark, clash.limit(0), "").count() == 0


def test_workers_get_few_texts_at_once(spark):
    """Each stage that runs Python code bounds the rows that a worker and its executor hold, and keeps a smaller bound that the session has."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "some words here", "en", "a", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get(conf)
    try:
        for name, stage in pipeline.STAGES:
            if name != "mixing":
                spark.conf.set(conf, 10_000)
                stage(spark, docs, "")
                assert int(spark.conf.get(conf)) == pipeline.BATCH_ROWS, name
        spark.conf.set(conf, 7)
        pipeline.packed(spark, docs, "")
        assert spark.conf.get(conf) == "7"
    finally:
        spark.conf.set(conf, before)


def test_near_dedup_takes_candidates_by_simhash(spark, monkeypatch):
    """Near copies are found by their SimHashes alone, with no MinHash bucket let through; exact similarity still decides."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"v{i}" for i in range(400)), "one text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = []

    def only_prints(rows):
        made.append(rows)
        return rows

    buckets, crowded = simhash.print_buckets, simhash.crowded
    monkeypatch.setattr(simhash, "print_buckets", lambda items: only_prints(buckets(items)))
    monkeypatch.setattr(simhash, "crowded", lambda rows: crowded(made[-1]))
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == {0, 2, 3}
