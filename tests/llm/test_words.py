"""Byte-level BPE, spelling variants and the divergence audit against their definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from pointloom.llm import bytebpe, divergence, spelling
from tests.llm.test_operators import empty_and_clashing

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, repeated rows and ids, empty and long texts, letters beyond ASCII."""
    rng = random.Random(5)
    words = ["letter", "leter", "letters", "better", "bitter", "Élanés", "élanés", "naïveté", "naiveté", "strasse", "straße", "word", "x×y÷zzz", "Ωmega", "日本語"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randrange(60)), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ü", None])) for i in range(60)]
    rows += [rows[0], rows[0], (None, text(30), None, None), (None, None, None, None), (7, None, "en", "a"), (8, "", "de", "empty"), (9, text(8000), "en", "a"), (10, " \n\t''  it's 12 ½   é", "fr", "only"), (11, "letter" * 3000, "en", "b")]
    return spark.createDataFrame(rows, SCHEMA)


# --- 11


@pytest.fixture(scope="module")
def encodings():
    return bytebpe.Encodings(bytebpe.read_ranks(bytebpe.ranks_path()))


@pytest.fixture(scope="module")
def library(encodings):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bytebpe.split_pattern(), mergeable_ranks=encodings.ranks, special_tokens={})


def test_trees_give_the_librarys_ids(encodings, library):
    rng, tokens = random.Random(3), list(encodings.ranks)
    makers = [
        lambda: bytes(rng.choice(b"ab ") for _ in range(rng.randrange(1, 300))),
        lambda: b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 60))),
        lambda: rng.choice(tokens) * rng.randrange(1, 50),
        lambda: bytes(rng.randrange(256) for _ in range(rng.randrange(1, 200))),
        lambda: "".join(rng.choice("éèàñíяжизнь") for _ in range(rng.randrange(1, 150))).encode(),
    ]
    for leaf in (1, 4, 64):
        tree = bytebpe.Encodings(encodings.ranks, leaf)
        for k in range(300):
            raw = makers[k % len(makers)]()
            want = library._encode_single_piece(raw)
            assert tree.encode(raw) == want and tree._merge_queue(raw) == want == tree._merge(raw) or raw in tree.ranks


def test_joins_associate(encodings):
    """Any bracketing gives one result, so that the reduction may be done in any shape."""
    rng = random.Random(8)
    for _ in range(200):
        a, b, c = (encodings.encode(bytes(rng.choice(b"aabcde") for _ in range(rng.randrange(0, 40)))) if rng.random() < 0.95 else [] for _ in range(3))
        assert encodings.join(encodings.join(a, b), c) == encodings.join(a, encodings.join(b, c))
        assert encodings.join([], a) == a == encodings.join(a, [])


def test_windows_grow_as_far_as_they_must(encodings):
    """A run of one letter after an odd start changes to its far end."""
    a, b = encodings._merge_queue(b"a" * 3001), encodings._merge_queue(b"a" * 4003)
    assert encodings.join(a, b) == encodings._merge_queue(b"a" * 7004)


def test_round_trip(awkward, library):
    encoded = bytebpe.encode(awkward)
    assert encoded.columns == ["doc_id", "lang", "source", "ids"]
    key = lambda r: (str(r.doc_id), str(r.lang), str(r.source))
    want = Counter((key(r), tuple(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in awkward.collect())
    back = bytebpe.decode(encoded.withColumn("again", F.col("ids")), "again")
    assert Counter((key(r), tuple(r.ids), bytes(r.decoded)) for r in back.collect()) == want


def test_bpe_query(spark, awkward, library, tmp_path):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, bytebpe.op11_bytebpe(spark, str(tmp_path)).collect()))
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    ids = {r.text: library.encode_ordinary(r.text or "") for r in awkward.collect()}
    assert got == Counter((r.doc_id, len(ids[r.text]), sha(",".join(map(str, ids[r.text])).encode()), sha((r.text or "").encode())) for r in awkward.collect())
    empty_and_clashing(awkward.drop("lang", "source"), bytebpe.encode)


# --- 12


def variants_by_brute_force(rows, min_chars=6, min_count=5, times=5, loss=199):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % loss == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    nears = {w: [v for v in n if v != w and near(v, w)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in nears.items()}
    form = {w: f if f and n[f] >= times * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, str(form[w]), root(w), n[w], len(nears[w]), str(n[form[w]] if form[w] else None)) for w in n)


def variants(df):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in df.collect())


def test_automaton_numbers_and_errors():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    automaton = spelling.Automaton(words)
    assert len(automaton) == len(words) and [automaton.number(w) for w in words] == list(range(len(words)))
    assert automaton.number("zzz") == automaton.number("") == -1
    assert len(automaton.final) < sum(map(len, words)) / 3  # shared ends are one state
    for w in [*words[:60], "abcabc"]:
        for exact in range(len(w) + 1):
            want = {i for i, v in enumerate(words) if v[:exact] == w[:exact] and v != w and ((len(v) == len(w) and sum(a != b for a, b in zip(v, w, strict=True)) == 1) or (len(v) == len(w) + 1 and any(v[:k] + v[k + 1 :] == w for k in range(exact, len(v)))))}
            assert automaton.one_error(w, exact) == want
    assert len(spelling.Automaton([])) == 0


def test_variants_equal_brute_force(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert variants(spelling.group_variants(awkward)) == variants_by_brute_force(rows)
    assert variants(spelling.group_variants(awkward, loss=3, min_count=1, times=2)) == variants_by_brute_force(rows, min_count=1, times=2, loss=3)
    empty_and_clashing(awkward.select("doc_id", "text"), spelling.group_variants)


@pytest.mark.parametrize("min_chars", [1, 6])
def test_large_groups_are_halved_again(docs_of, min_chars):
    """Words that share their beginning, their end or both; groups and shards of three words at most."""
    rng, texts = random.Random(4), []
    for _ in range(400):
        middle = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 5)))
        word = rng.choice(["common", "c", ""]) + middle + rng.choice(["ending", "e", ""])
        texts.append(" ".join([word] * rng.choice([1, 1, 2, 12, 70])))
    got = variants(spelling.group_variants(docs_of(texts), min_chars=min_chars, min_count=1, most=3, shard=5))
    assert got == variants_by_brute_force(list(enumerate(texts)), min_chars, 1)
    assert any(r[1] != "None" and r[1] != r[2] for r in got)  # chains of two and more


def test_pairs_are_unordered_halves(spark):
    """Every single error at every place of a word is found, once."""
    word = "abcdefghij"
    near = {word[:i] + "z" + word[i:] for i in range(11)} | {word[:i] + "z" + word[i + 1 :] for i in range(10)} | {word[:i] + word[i + 1 :] for i in range(10)}
    words = spark.createDataFrame([(w, 1) for w in sorted(near | {word, "abcdefghji"})], "word string, n long")
    got = [r.near for r in spelling.near_pairs(words).where(F.col("word") == word).collect()]
    assert sorted(got) == sorted(near)


# --- 13


def audit_by_brute_force(rows, min_docs=3, top=200):
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    terms = [(low(t), lang, s) for t, lang, s in rows]
    terms = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t), lang, s) for t, lang, s in terms]
    out = []
    for lang in {x[1] for x in rows}:
        here = [x for x in terms if x[1] == lang]
        seen = Counter(w for x in here for w in set(x[0]))
        kept = sorted(w for w, n in seen.items() if n >= min_docs)
        count = defaultdict(Counter)
        for words, _, s in here:
            count[s].update(w for w in words if w in set(kept))
        total = sum(count.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s in {x[2] for x in here}:
            pair = [(sum(f(p(count[s], w), p(count[o], w)) for w in kept), o) for o in {x[2] for x in here} - {s}]
            term = [(f(p(count[s], w), p(total, w)), w) for w in kept if count[s][w] and p(count[s], w) > p(total, w)]
            for part, found in (("pair", pair), ("term", term)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def test_audit_equals_brute_force(awkward):
    rows = [(r.text, r.lang, r.source) for r in awkward.collect()]
    for min_docs, top in ((3, 200), (1, 2), (60, 5)):
        got = divergence.audit(awkward, min_docs=min_docs, top_terms=top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == audit_by_brute_force(rows, min_docs, top)
    empty_and_clashing(awkward.drop("doc_id"), divergence.audit)


def test_audit_without_kept_terms(spark):
    df = spark.createDataFrame([(1, "one", "en", "a"), (2, "", "en", "b"), (3, None, "de", "a")], SCHEMA)
    assert sorted(map(tuple, divergence.audit(df).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_counts_are_sent_on_in_parts(awkward, monkeypatch):
    """A worker that holds few counts gives the same sums."""
    whole = sorted(map(tuple, divergence.term_counts(awkward).collect()))
    words = sorted(map(tuple, spelling.word_counts(awkward, min_count=1).collect()))
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(spelling, "HELD", 3)
    assert sorted(map(tuple, divergence.term_counts(awkward).collect())) == whole
    assert sorted(map(tuple, spelling.word_counts(awkward, min_count=1).collect())) == words


@pytest.mark.parametrize(("run", "sql"), [(spelling.op12_spelling, spelling.OP12_SQL), (divergence.op13_divergence, divergence.OP13_SQL)])
def test_queries_equal_sql(spark, awkward, tmp_path, run, sql):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = run(spark, str(tmp_path))
    want = con.sql(sql).project(", ".join(got.columns)).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
