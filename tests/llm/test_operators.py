"""The corpus operators against brute force on small fixtures with nulls, ties, repeats, empty and long texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm import components, exact_dedup, htmltext, langid, linededup, mixing, packing, simhash, spotsigs, substrings, urlfilter, verify

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll lagoon meadow north ocean prairie quarry ridge summit thicket".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ing"]) + str(rng.randrange(30)) for _ in range(n))


def edited(text, seed, k):
    rng, parts = random.Random(seed), text.split()
    for _ in range(k):
        parts[rng.randrange(len(parts))] = "changed" + str(rng.randrange(99))
    return " ".join(parts)


BASE = prose(1, 200)
FIXTURE = [BASE, BASE, edited(BASE, 2, 2), None, "", "", "Ab ÄB", "aB ÄB", "ab äb", "   \n\t", prose(3, 3000), prose(3, 3000) + " tail", "x", "Émile\nÉmile\n\nx", prose(4, 150), edited(prose(4, 150), 5, 1)]


def test_predictions_average_the_windows(docs_of):
    """Whole texts: each window's probabilities, weighted by its bytes, by the plain definition of the network."""
    model = langid.train(["some words here " * 9, "andere Worte hier " * 9, "otras palabras " * 9], ["en", "de", "es"], epochs=2)
    texts = ["some words", prose(5, 200), "é" * 700, "x" * langid.WINDOW, "y" * (langid.WINDOW + 1)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs_of(texts), model).collect()}
    for i, text in enumerate(texts):
        raw = text.encode()
        total = np.zeros(3)
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW]
            window = np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)
            emb = model.embed[window]
            tops = []
            for k, f, b in zip(langid.WIDTHS, model.filters, model.bias):
                conv = [sum(emb[t + j] @ f[j] for j in range(k)) + b for t in range(langid.WINDOW - k + 1)]
                tops.append(np.max(conv, axis=0))
            z = np.maximum(np.concatenate(tops), 0) @ model.dense + model.dense_bias
            total += len(part) * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        mean = total / len(raw)
        assert got[i][0] == model.langs[int(mean.argmax())] and abs(got[i][1] - mean.max()) < 1e-4


def test_only_letters_have_a_language(docs_of):
    """Numerals that are not letters, though Python calls them alphanumeric; a stand-in model would name a language for any text."""
    model = langid.train(["some words here", "andere Worte hier"], ["en", "de"], epochs=1)
    docs = docs_of(["\u00b2", "\u00bd \u2167", "12 _", "\u00e9", "\u6f22", None, ""])
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert [got[i] == "und" for i in range(7)] == [True, True, True, False, False, True, True]


def table(df):
    return [r.asDict() for r in df.collect()]


def empty_and_clashing(docs, run):
    """An empty table gives an empty result; columns named like internal ones change nothing."""
    assert run(docs.limit(0)).count() == 0
    clash = docs
    for name in ("id", "t", "h", "th", "fp", "size", "rank", "range", "norm", "item", "key", "bucket", "src", "spans", "lang_pred"):
        clash = clash.withColumn(name, F.lit("clash"))
    order = lambda df: sorted(map(str, df.collect()))
    columns = run(docs).columns
    assert order(run(clash).select(*columns)) == order(run(docs))


def test_predictions_with_clashing_columns(docs_of):
    """With a model that predicts; columns named like internal ones, repeated and null ids."""
    model = langid.train(["some words here " * 9, "andere Worte hier " * 9], ["en", "de"], epochs=1)
    docs = docs_of([(1, "some words"), (1, "some words"), (None, "andere Worte"), (2, None), (3, "")])
    empty_and_clashing(docs, lambda d: langid.identify(d, model))


# --- 1


def test_exact_dedup(docs_of):
    docs = docs_of([*FIXTURE, (0, BASE), (None, "x"), (None, "only")])
    want = defaultdict(list)
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        want[low(r.text)].append(r.doc_id)
    for capacity, limit in ((1 << 16, 10**6), (2, 0)):  # the second splits buckets and shuffles all texts
        got = table(exact_dedup.exact_dedup(docs, capacity=capacity, broadcast_keys=limit))
        assert len(got) == len(rows)
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
        for g in got:
            ids = by_sha[g["text_sha256"]]
            keep = max((i for i in ids if i is not None), default=None)
            assert (g["keep_id"], g["group_size"], g["kept"]) == (keep, len(ids), g["doc_id"] == keep)
            assert (g["bucket"] is None) == (len(ids) == 1) and g["chain"] in (None, 1)
        held = defaultdict(set)
        for g in got:
            held[g["bucket"]].add(g["text_sha256"])
        held.pop(None)
        assert (len(held) > 1) == (capacity == 2) and max(map(len, held.values())) <= capacity
    empty_and_clashing(docs, exact_dedup.exact_dedup)


def test_keys_that_collide_are_chained_by_their_bytes(docs_of, monkeypatch):
    """With one key for all texts, one bucket holds one chain, and bytes alone tell texts apart."""
    one = type("Collide", (), {"__getattr__": lambda _, name: (lambda *c: F.lit(7).cast("long")) if name == "xxhash64" else getattr(F, name)})()
    monkeypatch.setattr(exact_dedup, "F", one)
    got = exact_dedup.exact_dedup(docs_of(["a", "A", "b", "c", "b"])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(0, 1, 2), (1, 1, 2), (2, 4, 2), (3, 3, 1), (4, 4, 2)]
    assert {r.chain for r in got} == {1, 2, 3} and len({r.bucket for r in got}) == 1


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("h"))
    d = exact_dedup.directory(keys, 100).toPandas()
    depth = d.global_depth.iloc[0]
    assert len(d) <= 1 << depth and d.depth.max() >= 5
    cell = keys.select(F.shiftrightunsigned("h", int(64 - depth)).alias("cell")).toPandas().cell
    assert cell.map(d.set_index("cell").bucket).value_counts().max() <= 100


# --- 2


def lines_by_brute_force(rows):
    occ = [(linededup.normal(x), i, p) for i, t in rows for p, x in enumerate((t or "").split("\n")) if linededup.normal(x)]
    first = {}
    for n, i, p in occ:
        first[n] = min(first.get(n, (i, p)), (i, p))
    keys = list(first)
    sets = [linededup.shingle_set(k) for k in keys]
    a, b = zip(*[(i, j) for i in range(len(keys)) for j in range(i + 1) if i == j or verify.jaccard(sets[i], sets[j], 0.8)])
    root = dict(zip(*components.union_find(np.array(a), np.array(b))))
    keep = {}
    for i, k in enumerate(keys):
        keep[root[i]] = min(keep.get(root[i], first[k]), first[k])
    at = {k: root[i] for i, k in enumerate(keys)}
    gone = {(i, p) for n, i, p in occ if keep[at[n]] != (i, p)}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows if t is not None}


def test_line_dedup(docs_of):
    line = prose(7, 12)
    rows = [(0, f"{line}\n\nkeep me"), (1, edited(line, 8, 1) + "\nother line here"), (2, line.upper() + "  \nlast"), (3, None), (4, ""), (5, "ab\nab"), (6, prose(9, 400)), (7, prose(9, 400) + " more")]
    docs = docs_of(rows)
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    want = lines_by_brute_force(rows)
    assert {i: got[i].text for i in want} == want and got[3].text is None
    assert got[2].text == "last" and got[0].n_lines == 3 and got[5].n_removed == 1 and got[7].text == ""
    assert set(docs.columns) < set(linededup.dedup_lines(docs).columns)
    empty_and_clashing(docs, linededup.dedup_lines)


def test_sets_of_lines_together_and_white_space():
    """Sets made together are those made one by one; a line's normal form is its lower-cased words, whatever the white space."""
    rng = random.Random(5)
    lines = ["", "a", "12345678", "aaaaaaaaaaaaaaaa", prose(1, 30_000), *["".join(rng.choices("abAB \t\u00a0\u2003\u3000\x1c\x85\u00c9\u0130\u200b", k=rng.randint(0, 30))) for _ in range(2_000)]]
    assert all(np.array_equal(a, linededup.shingle_set(x)) for a, x in zip(linededup.shingle_sets(lines), lines, strict=True))
    assert [linededup.normal(x) for x in lines] == [" ".join(x.lower().split()) for x in lines]


def test_bucket_blocks_lose_no_link(spark):
    """A large bucket is compared in blocks of two and gives the same components."""
    base = prose(10, 40)
    texts = [edited(base, s, 1) for s in range(12)] + [prose(s, 40) for s in range(20, 24)]
    members = spark.createDataFrame([(b, i) for b in (1, 2) for i in range(len(texts))], "bucket long, item long")
    found = verify.similar_links(members, spark.createDataFrame(list(enumerate(texts)), "item long, text string"), linededup.shingle_set, 0.8, block=2)
    roots = {r.node: r.root for r in components.components(found).collect()}
    sets = [linededup.shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if verify.jaccard(sets[i], sets[j], 0.8)]
    want = dict(zip(*components.union_find(*map(np.array, zip(*pairs)))))
    assert roots == want


def test_big_buckets_are_divided_by_other_buckets(spark):
    """Three families of like lines in one bucket of boilerplate, with their own bands beside it: the links are the same when the bucket is divided."""
    families = [prose(200 + f, 14) for f in range(3)]
    texts = [f"{families[i % 3]} {i}" for i in range(30)] + [prose(300 + i, 12) for i in range(20)]
    bands = linededup.band_hashes(texts)
    rows = [(int(b), i) for i in range(len(texts)) for b in bands[i]] + [(77, i) for i in range(len(texts))]
    members = verify.crowded(spark.createDataFrame(rows, "bucket long, item long"))
    table_ = spark.createDataFrame(list(enumerate(texts)), "item long, text string")
    roots = []
    for split in (verify.SPLIT, 5):
        found = verify.similar_links(members, table_, linededup.shingle_set, 0.8, block=4, split=split)
        roots.append({r.node: r.root for r in components.components(found).collect()})
    assert roots[0] == roots[1] and set(roots[0].values()) == {0, 1, 2}
    sizes = verify.finer(members, members.groupBy("bucket").agg(F.count("*").alias("n")), 5).groupBy("bucket").count().agg({"count": "max"}).head()[0]
    assert sizes < 50


def test_big_buckets_keep_pairs_that_share_no_other(spark):
    """Like lines whose only bucket is a big one are linked, beside a group of near copies and lines unlike all."""
    bases = [prose(400 + f, 14) for f in range(20)]
    texts = [edited(prose(399, 40), s, 1) for s in range(24)] + [f"{bases[i % 20]} {i}" for i in range(40)] + [prose(500 + i, 12) for i in range(10)] + ["", "short"]
    members = spark.createDataFrame([(77, i) for i in range(len(texts))] + [(78, i) for i in range(10, 50)], "bucket long, item long")
    table_ = spark.createDataFrame(list(enumerate(texts)), "item long, text string")
    found = verify.similar_links(members, table_, linededup.shingle_set, 0.8, block=4, split=5)
    sets = [linededup.shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if verify.jaccard(sets[i], sets[j], 0.8)]
    want = dict(zip(*components.union_find(*map(np.array, zip(*pairs)))))
    assert {r.node: r.root for r in components.components(found).collect()} == want and len(set(want.values())) > 15


def test_lines_that_share_the_first_part_of_their_name(docs_of):
    """With one bit to group by, different lines share it: of those one is grouped, and no line goes that is not repeated."""
    lines = [f"{w} {w}{i} is a line of its own" for i, w in enumerate(WORDS[:8])]
    docs = docs_of([*lines, *lines[:4]])
    out = {r.doc_id: r.text for r in linededup.dedup_lines(docs, key_bits=1).collect()}
    assert all(out[i] for i in range(8)) and 1 <= sum(not out[8 + i] for i in range(4)) <= 2


@pytest.mark.parametrize("last", [0, 10**6])
def test_components(spark, last):
    rng = random.Random(11)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 60)] + [(9, 9), (7777, 7777)]
    edges = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges, last).collect()}
    want = dict(zip(*components.union_find(*map(np.array, zip(*pairs)))))
    assert got == want


# --- 3


def test_url_cascade(spark):
    urls = ["https://a.example.com/en/7x", "http://EXAMPLE.com/en/9?q", "http://notexample.com/en/7", "https://x.org/es/#f", "nothing", None, "http://net/de/8", "http://example.net/de/8", "ftp://h.example.net/de/81/x://y", "http://com", "://com/en/"]
    urls += [f"http://h{i}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'es', 'fr')[i % 4]}/{i}" for i in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [*urlfilter.RULES, *[(f"h{i}.example.com", f"/en/{i}", ("allow", "block")[i % 2]) for i in range(0, 60, 3)]]

    def judge(url):
        rest = (url or "").partition("://")
        tail = rest[2] if rest[1] else ""
        host = tail
        for c in "/?#":
            host = host.split(c)[0]
        path = tail[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rule_table(spark, rules)).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}
    joined = urlfilter.judge(pages, urlfilter.rule_table(spark, rules), most_keys=0)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in joined.collect()} == got
    more = pages.union(spark.createDataFrame([(3, urls[0]), (None, urls[1]), (None, None)], pages.schema)).withColumns({c: F.lit("clash") for c in ("id", "host", "path", "rule", "keys", "key", "row", "verdict")})
    for most in (0, urlfilter.MOST_KEYS):
        out = urlfilter.judge(more, urlfilter.rule_table(spark, rules), most_keys=most).collect()
        assert len(out) == len(urls) + 3 and sum(r.page_id == 3 for r in out) == 2
        assert sorted((str(r.host), str(r.verdict)) for r in out if r.page_id is None) == sorted((judge(u)[0], judge(u)[3]) for u in (urls[1], None))
    assert urlfilter.judge(pages, urlfilter.rule_table(spark, rules).limit(0)).where("verdict = 'allow' and rule is null").count() == len(urls)
    assert urlfilter.judge(pages.limit(0), urlfilter.rule_table(spark)).count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 10])
def test_levels_too_large_are_joined(spark, monkeypatch, bits):
    """A universe, or a list, whose keys overfill a level gives the same verdicts."""
    urls = [f"http://h{i % 40}.example.com/en/{i}" for i in range(3000)] + ["http://www.example.net/de/8", None, "x" * 50_000, "http://" + "a." * 300 + "com/en/" + "y" * 20_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = urlfilter.rule_table(spark, [*urlfilter.RULES, *[(f"h{i}.example.com", f"/en/{i}", "allow") for i in range(30)]])
    want = sorted(map(str, urlfilter.judge(pages, rules).collect()))
    monkeypatch.setattr(urlfilter, "MOST_BITS", bits)
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 2)
    assert sorted(map(str, urlfilter.judge(pages, rules).collect())) == want
    with pytest.raises(urlfilter.LevelTooLarge):
        urlfilter.build_level(pages.select(F.col("url").alias("key")), 1, 5000)


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 7 = 0")
    urlfilter.BITS_PER_KEY, before = 2, urlfilter.BITS_PER_KEY  # many false positives: several levels
    try:
        cascade = urlfilter.Cascade(listed, universe)
    finally:
        urlfilter.BITS_PER_KEY = before
    assert len(cascade.levels) > 2
    assert universe.where(cascade.has(F.col("key")) != F.expr("hash(key) % 7 = 0")).count() == 0


# --- 4

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>H</header><nav>menu</nav><div class="cookie-notice">c</div>
<article><h1>Big &amp; small</h1><p>One <b>two</b>three<br>four<p>Fünf&nbsp;six<div class="ad">ad</div><form>f</form><section id="comments">no</section><footer>foot</footer></article>
<aside>side</aside><footer>f</footer></body></html>"""


def extracted(page):
    return htmltext.main_text(htmltext.parse(page))


def test_main_text():
    assert extracted(PAGE) == "Big & small One twothree four Fünf six"
    assert extracted("<div class='page-header'>no</div><article><div class='post-header'><h1>Head</h1></div>text</article>") == "Head text"
    assert extracted("") == "" and extracted("plain <i>text") == "plain text"
    assert extracted("<p>a > b" + " x" * 50_000).startswith("a > b x x")
    assert extracted("a <b title='x > y'>b</b> 1 < 2 <!-- no --> <![CDATA[no]]> c<SCRIPT>no</ScripT >d<svg><text>no</text></svg>e") == "a b 1 < 2 cde"


def test_tags_are_cut_as_browsers_do():
    cut = lambda page: [(k, t, *a) for k, t, a in htmltext.tokens(page)]
    assert cut("<a b='x>y' class=k ID = \"q\">t</a >") == [("start", "a", ("class", "k"), ("id", "q")), ("text", "t"), ("end", "a")]
    assert cut("1 < 2 <3") == [("text", "1 "), ("text", "<"), ("text", " 2 "), ("text", "<"), ("text", "3")]
    assert cut("<p class=\"a>b") == [("start", "p", ("class", '"a')), ("text", "b")]
    assert cut("x<!-- > --><!doctype y><?z?><script>1</SCRIPT>w<style>") == [("text", "x"), ("start", "script"), ("end", "script"), ("text", "w"), ("start", "style")]
    assert cut("a<b c") == [("text", "a")]


@pytest.mark.parametrize("page", ["<a " + "\"" * 2000, "<a " + "\"'" * 50_000, "<a b" * 50_000, "<a b=\"" * 30_000, "<" * 50_000, "<!--" * 50_000, "<script>" * 50_000, "<a" + " " * 100_000, "&" * 100_000, "<div>" * 10_000 + "</x>" * 10_000])
def test_hostile_markup_takes_linear_time(page):
    import time

    began = time.perf_counter()
    extracted(page)
    assert time.perf_counter() - began < 2


def site_tree(pages):
    """The style trees of (host, html) by their definition: host to (pages, {node: (pages, importance)})."""
    hosts = defaultdict(dict)
    for host, page in pages:
        hosts[host][page] = htmltext.parse(page)
    entropy = lambda xs: -sum(xs.count(x) / len(xs) * np.log(xs.count(x) / len(xs)) for x in set(xs)) / np.log(len(xs))
    out = {}
    for host, unique in hosts.items():
        seen = defaultdict(list)
        for p in unique.values():
            for _, node, layout, below, *_ in p.containers:
                seen[node].append((layout, below))
        total = len(seen[0])
        judged = {k: v for k, v in seen.items() if len(v) >= max(htmltext.MIN_PAGES, htmltext.PART * total)}
        out[host] = total, {k: (len(v), htmltext.GAMMA * entropy([x[1] for x in v]) + (1 - htmltext.GAMMA) * entropy([x[0] for x in v])) for k, v in judged.items()}
    return out


def site(host, n, marked):
    """Pages of a site with a menu, an advert and a footer, whose articles differ in layout; the article's text beside each."""
    names = ("<nav>{}</nav>", "<div class='ad'>{}</div>", "<article>{}</article>", "<footer>{}</footer>") if marked else ("<div>{}</div>",) * 4
    for i in range(n):
        parts = [prose(1000 * n + 50 * i + k, 12) for k in range(1 + i % 7)]
        article = "".join(f"<p>{x}" if k else f"<h1>{x}</h1>" for k, x in enumerate(parts))
        menu = "".join(f"<li><a href='/{k}'>{prose(i % 5 + k, 1)}</a>" for k in range(4))
        inside = (f"<ul>{menu}</ul>", prose(i % 3, 6), article, f"&copy; {host} &middot; {prose(i % 4, 5)}")
        yield f"http://{host}/{i}", f"<html><head><title>t</title></head><body>{''.join(a.format(x) for a, x in zip(names, inside))}</body></html>", " ".join(parts)


@pytest.mark.parametrize("marked", [True, False])
def test_extraction_against_trees_by_their_definition(spark, marked):
    """Names marked or not, the pages of every site give their articles; and each page's text is that of the tree built by definition."""
    made = [x for host, n in (("a.org", 30), ("b.org", 60), ("c.net", 12), ("d.net", 2)) for x in site(host, n, marked)]
    rows = [(i, u, h) for i, (u, h, _) in enumerate(made)] + [(7, *made[7][:2]), (None, *made[8][:2]), (900, None, "<p>lone"), (901, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = htmltext.extract(df).collect()
    assert len(got) == len(rows)
    host = lambda u: (u or "://").split("://")[1].split("/")[0]
    trees = site_tree([(host(u), h or "") for _, u, h in rows])
    want = sorted((str(i), str(u), htmltext.main_text(htmltext.parse(h or ""), *trees[host(u)][::-1])) for i, u, h in rows)
    assert sorted((str(r.page_id), str(r.url), r.text) for r in got) == want
    assert {r.decided_by for r in got if r.url and ("a.org" in r.url or "b.org" in r.url)} == {"tree"} and {r.decided_by for r in got if r.url is None or "d.net" in r.url} == {"names"}
    right = {r.page_id: r.text for r in got}
    assert all(right[i] == " ".join(made[i][2].split()) for i in range(len(made)) if marked or "d.net" not in made[i][0])
    clash = df.withColumns({c: F.lit("x") for c in ("id", "host", "text", "node", "copy", "tree", "row")})
    assert sorted(map(str, htmltext.extract(clash).collect())) == sorted(map(str, got))


@pytest.mark.parametrize("limit", [10**6, 0])
def test_style_tree_drops_what_a_site_repeats(spark, limit):
    pages = [(i, f"http://site.org/{i}", f"<body><div class=top>Welcome to us</div><div class=text>{prose(i, 30)}</div></body>") for i in range(8)]
    pages += [(20, "http://one.org/", "<body><div class=top>Welcome to us</div></body>"), (21, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(df, broadcast_nodes=limit).collect()}
    assert all(got[i] == prose(i, 30) for i in range(8))
    assert got[20] == "Welcome to us" and got[21] == ""
    assert htmltext.extract(df.limit(0)).count() == 0


def test_the_tree_outvotes_names(spark):
    """Where a site has pages enough, names mislead no longer: its articles are called ads, what it repeats is called its article; a lone host's are believed."""
    page = lambda k: f"<body><div class='main'>Welcome to {k % 3}</div><div class='ad'>{''.join(f'<p>{prose(90 * k + j, 9)}' for j in range(1 + k % 5))}</div></body>"
    rows = [(i, f"http://many.org/{i}", page(i)) for i in range(40)] + [(90, "http://few.org/", page(5))]
    got = {r.page_id: (r.text, r.decided_by) for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (" ".join(prose(90 * i + j, 9) for j in range(1 + i % 5)), "tree") for i in range(40))
    assert got[90] == ("Welcome to 2", "names")


def test_style_tree_keeps_copied_pages(spark):
    page = lambda k: f"<body><div class=text>{prose(k, 30)}</div></body>"
    rows = [(i, f"http://copies.org/?q={i}", page(0)) for i in range(4)] + [(10 + i, f"http://two.org/?q={i}", page(i % 2)) for i in range(20)]
    rows += [(40 + i, f"http://near.org/{i}", f"<!-- {i} -->{page(2)}") for i in range(4)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == prose(0, 30) for i in range(4)) and all(got[10 + i] == prose(i % 2, 30) for i in range(20))
    assert all(got[40 + i] == prose(2, 30) for i in range(4))


# --- 5

ALPHABETS = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "der", "ein", "ung"], "cc": ["eau", "oi", "que", "ent"]}


def sentence(lang, seed, n=30):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_id(spark):
    rows = [(i, sentence(("aa", "bb", "cc")[i % 3], i), ("aa", "bb", "cc")[i % 3]) for i in range(240)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ..!", "bb"), (1003, sentence("cc", 5, 5000), None), (None, sentence("bb", 1), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs, langid.fit(docs), carry=("lang",)).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    by = out.set_index("doc_id")
    assert (by.loc[[1000, 1001, 1002]].lang_pred == "und").all() and by.loc[1003].lang_pred == "cc"
    for i in (0, 5, 77):
        assert by.loc[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = out[out.held_out & out.lang.notna() & (out.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert langid.identify(docs.limit(0), None).count() == 0 and langid.fit(docs.limit(0)) is None
    empty_and_clashing(docs.select("doc_id", "text"), lambda d: langid.identify(d, None))


def test_tables_equal_the_network():
    model = langid.train([sentence(x, i) for x in ALPHABETS for i in range(40)], [x for x in ALPHABETS for _ in range(40)], epochs=1)
    w = langid.cut(sentence("bb", 3).encode())
    emb = model.embed[w]
    top = np.concatenate([sum(emb[:, j : j + langid.WINDOW - k + 1] @ f[j] for j in range(k)).max(1) + b for k, f, b in zip(langid.WIDTHS, model.filters, model.bias)], 1)
    assert np.allclose(model.probabilities(w, model.tables()), langid._softmax(np.maximum(top, 0) @ model.dense + model.dense_bias), atol=1e-4)


# --- 6


def slow_print(text, words=3):
    import xxhash

    parts = [w for w in (text or "").encode().lower().split()]
    runs = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([b" ".join(parts)] if parts else [])
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(r, 42) >> b & 1 for r in runs) > len(runs))


def test_simhash_components(docs_of):
    rows = [*enumerate([*FIXTURE, *[edited(BASE, 100 + s, 1) for s in range(10)]]), (None, BASE), (3, "again")]
    docs = docs_of(rows)
    got = table(simhash.near_groups(docs))
    prints = [slow_print(t) for _, t in rows]
    root, ids = list(range(len(rows))), [i for i, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    root = dict(zip(*components.union_find(*map(np.array, zip(*pairs)))))
    name = {r: min((ids[i] for i in root if root[i] == r and ids[i] is not None), default=None) for r in root.values()}
    want = sorted((str(i), f"{p:016x}", name[root[k]]) for k, (i, p) in enumerate(zip(ids, prints)))
    assert sorted((str(g["doc_id"]), g["fingerprint"], g["component_id"]) for g in got) == want
    empty_and_clashing(docs, simhash.near_groups)


def test_links_of_random_fingerprints(spark):
    rng = random.Random(12)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for k in range(5):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), k)))
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    for radius, segments in ((3, 2), (5, 2), (3, 4)):
        got = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, segments).collect()}
        want = {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= radius}
        assert got == want


def test_fingerprint_tables_are_not_broadcast(docs_of, monkeypatch):
    """Tables that grow with the documents stay out of the driver, however small their files seem."""
    plans, write = [], simhash.materialize
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (simhash, components):
        monkeypatch.setattr(module, "materialize", lambda df, name: seen(df) or write(df, name))
    union = components.components
    monkeypatch.setattr(simhash, "components", lambda edges: union(edges, 0))
    seen(simhash.near_groups(docs_of([*FIXTURE, *[edited(BASE, 100 + s, 1) for s in range(10)]])))
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


def test_near_duplicates(docs_of):
    rows = [(i, t) for i, t in enumerate([BASE, edited(BASE, 2, 1), edited(BASE, 3, 1), prose(20, 90), prose(21, 90), BASE, None, "", "short", "short", prose(22, 2000), edited(prose(22, 2000), 4, 3)])]
    left = {r.doc_id for r in simhash.drop_near_duplicates(docs_of(rows)).collect()}
    assert left == {0, 3, 4, 6, 7, 8, 10}
    assert simhash.drop_near_duplicates(docs_of(rows).limit(0)).count() == 0


def test_near_duplicates_in_a_big_bucket(docs_of, monkeypatch):
    """Near copies that share no bucket but a big one go."""
    texts = [prose(700 + i % 15, 60) + f" {i}" for i in range(30)] + [prose(800 + i, 60) for i in range(5)]
    monkeypatch.setattr(simhash, "crowded", lambda rows: rows.select(F.lit(77).cast("long").alias("bucket"), "item").distinct())
    monkeypatch.setattr(simhash, "similar_links", lambda *given: verify.similar_links(*given, block=4, split=5))
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs_of(texts)).collect()} == {*range(15), *range(30, 35)}


def test_near_duplicates_with_a_passage_more_or_less(docs_of):
    texts = [prose(900 + i, 120) for i in range(40)]
    more = [t + " " + prose(2000 + i, 20 + i % 8) for i, t in enumerate(texts[:20])]
    less = [" ".join(t.split()[: 98 + i % 8]) for i, t in enumerate(texts[20:])]
    for a, b in zip(texts, more + less, strict=True):
        assert verify.jaccard(simhash.shingle_set(a), simhash.shingle_set(b), 0.8)
    left = {r.doc_id for r in simhash.drop_near_duplicates(docs_of(texts + more + less)).collect()}
    assert left == set(range(40))


# --- 7


def test_mixing(docs_of):
    rng = random.Random(13)
    rows = [(i, prose(i, rng.randrange(1, 30)), ("big", "mid", None, "tiny")[0 if i % 3 else i % 4]) for i in range(400)] + [(500, None, "void"), (501, "", "void"), (7, prose(7, 5), "mid"), (None, "a b", "big")]
    docs = docs_of(rows)
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and sorted(got.taken) == sorted(mixing.mix(docs).toPandas().taken)
    sizes = got.groupby(got.source.fillna("~"))["size"].sum()
    order = sorted(sizes.index)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sizes.sum()
    while True:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * share for s in free}
    for s, part in got.groupby(got.source.fillna("~")):
        assert np.allclose(part.target, target[s]) and abs(part.taken.sum() - target[s]) <= part["size"].max()
    empty_and_clashing(docs, mixing.mix)


# --- 8


def test_spotsigs(docs_of):
    rows = [*enumerate(FIXTURE), (100, "the cat sat on the mat and the dog ran in the park"), (101, "..."), (10_000, BASE), (3, "the same id")]
    docs = docs_of(rows)
    got = sorted(table(spotsigs.spot_fingerprints(docs)), key=lambda g: g["doc_id"])
    assert len(got) == len(rows)
    texts = {g["doc_id"]: t or "" for g, (_, t) in zip(got, sorted(rows, key=lambda r: r[0])) if g["doc_id"] != 3}
    ids = sorted(texts)
    follow = {i: texts[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids) if i not in (2,)}
    for g in got:
        i = g["doc_id"]
        if i in follow and i != 3:
            t, q = texts[i], len(texts[i]) // 4
            e = t[: len(t) - q] + follow[i][:q]
            assert (g["n_chars"], g["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
            if e == t:
                assert g["near_edited"] == 1.0
        sets = [set(zip(*[iter(g[c])] * 8)) for c in ("fingerprint", "edited_fingerprint")]
        union = len(sets[0] | sets[1])
        exact = len(sets[0] & sets[1]) / union if union else 1.0
        assert abs(g["near_edited"] - exact) < 1e-12
    nulls = table(spotsigs.spot_fingerprints(docs_of([(None, "b"), (None, None), (4, BASE), (None, "b")])))
    assert [g["n_chars"] for g in sorted(nulls, key=lambda g: g["n_chars"])] == [0, 1, 1, len(BASE)]
    last = next(g for g in nulls if g["doc_id"] == 4)  # null ids come first: the last row is followed by one of them
    quarter = BASE[: len(BASE) - len(BASE) // 4]
    assert last["edited_sha256"] in {hashlib.sha256((quarter + t).encode()).hexdigest() for t in ("", "b")}
    by = {g["doc_id"]: g for g in got}
    for i in set(follow) - {3}:  # lengths do not matter: also sets of which one is a hundred times the other
        a, b = (set(zip(*[iter(by[j]["fingerprint"])] * 8)) for j in (i, ids[(ids.index(i) + 1) % len(ids)]))
        if ids[(ids.index(i) + 1) % len(ids)] != 3:
            assert abs(by[i]["near_next"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
    assert by[0]["fingerprint"] == by[1]["fingerprint"] == by[10_000]["fingerprint"] and by[0]["near_next"] == 1.0
    assert by[0]["near_edited"] > 0.6 and by[12]["near_next"] < 0.2 and by[4]["fingerprint"] == ""
    empty_and_clashing(docs, spotsigs.spot_fingerprints)


def plain_spots(text):
    """The spots of a text by their definition: (anchor, its chain) for each anchor."""
    import regex

    anchors = set(spotsigs.ANCHORS)
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    third = lambda w: THIRD[w]
    spots = []
    for i, w in enumerate(words):
        bare = not any(x in anchors for x in words[max(i - spotsigs.GAP, 0) : i])
        if w in anchors or i == 0 or (bare and third(w)):
            spots.append((w, tuple([x for x in words[i + 1 : i + 1 + spotsigs.LOOKAHEAD] if x not in anchors][: spotsigs.CHAIN])))
    return spots


THIRD = {}


def test_signatures_are_the_spots_by_definition(spark, docs_of):
    """Of each text the number of signatures is that of its different spots, and two texts share as many as they share spots."""
    texts = ["the cat sat on the mat and the dog ran in the park", "a dog ran on the mat and the cat sat in a park", prose(9, 60), prose(9, 60) + " the end of it", "one", "it is the of", "Über das Haus und der Hund im Garten", "x, y; z " * 20]
    words = {w for t in texts for w in spark.createDataFrame([(t,)], "t string").select(F.split(F.lower("t"), r"[^\p{L}\p{N}]+")).head()[0] if w}
    marks = spark.createDataFrame([(w,) for w in words], "w string").select("w", (F.pmod(F.hash("w"), F.lit(3)) == 0).alias("third")).collect()
    THIRD.update({r.w: r.third for r in marks})
    got = {r.doc_id: set(r.sigs) for r in docs_of(texts).select("doc_id", spotsigs.signatures(F.col("text")).alias("sigs")).collect()}
    want = {i: set(plain_spots(t)) for i, t in enumerate(texts)}
    for i in got:
        for j in got:
            assert len(got[i] & got[j]) == len(want[i] & want[j]), (i, j)


def test_next_row_over_sparse_keys(spark):
    keys = sorted({random.Random(14).randrange(-(1 << 40), 1 << 40) for _ in range(50)} | set(range(1000)))
    rows = spark.createDataFrame([(k, 0, str(k)) for k in keys], "key long, tie long, v string")
    got = {r.v: r.next_v for r in spotsigs.with_next(rows, ["v"]).collect()}
    assert got == {str(k): str(keys[(i + 1) % len(keys)]) for i, k in enumerate(keys)}


def test_spot_pairs(docs_of):
    texts = [" ".join(f"the {w} and {v}" for w, v in zip(prose(s, 40).split(), prose(s + 50, 40).split())) for s in range(6)]
    docs = docs_of([*texts, texts[0], edited(texts[1], 3, 2), edited(texts[2], 4, 1)])
    member, pairs = spotsigs.near_pairs(docs, 0.8)
    assert {r.doc_id: r.class_id for r in member.collect()}[6] == 0
    sets = {r.doc_id: set(r.sigs) for r in docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("sigs")).collect()}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and 6 not in (a, b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {frozenset((r.a, r.b)) for r in pairs.collect()} == want and want


# --- 9


@pytest.mark.parametrize(("limit", "keys"), [(1000, substrings.KEYS), (1, substrings.KEYS), (1000, 0)])
def test_repeated_substrings(docs_of, limit, keys):
    shared = prose(30, 150)
    rows = [(0, prose(31, 60) + shared + prose(32, 60)), (1, prose(33, 90) + shared[100:900] + "ö" * 30), (2, shared[:399]), (3, None), (4, ""), (5, "ab" * 700), (6, shared), (7, shared), (8, prose(34, 80) + shared[50:460] + prose(35, 30) + shared[300:800])]
    rows += [(9 + i, prose(40 + i, 20) + shared[200:760] + prose(60 + i, 20)) for i in range(5)]
    count = defaultdict(int)
    raw = {i: (t or "").encode() for i, t in rows}
    for b in raw.values():
        for k in range(len(b) - 399):
            count[b[k : k + 400]] += 1
    want = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest(), left)
    docs, spans = docs_of(rows), substrings.repeated_spans
    substrings.repeated_spans = lambda d, i, t: spans(d, i, t, limit, keys)
    try:
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in substrings.dedup_substrings(docs, with_text=True).collect()}
    finally:
        substrings.repeated_spans = spans
    assert got == want
    if limit > 1 and keys:
        empty_and_clashing(docs, substrings.dedup_substrings)


def test_passage_in_many_contexts_and_repetitive_text(docs_of):
    """One passage in 3,000 contexts goes the way of the hot anchors; a text of equal bytes is as many windows of one piece."""
    passage = prose(30, 110)
    around = [prose(1000 + i, 12) for i in range(3000)]
    rows = [(i, f"{around[i]}\n{passage}\n{around[-i]}") for i in range(3000)]
    rows += [(5000, "x" * 1_000_000), (5001, "ab" * 100_000), (5002, "y" * 399), (None, rows[0][1]), (None, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.dedup_substrings(docs_of(rows)).collect() if r.doc_id is not None}
    raw = {i: t.encode() for i, t in rows if t}
    copies = {0}  # also under a null id
    for i in range(3000):
        at, size = raw[i].index(passage.encode()), len(passage)
        n, removed, spans = got[i]
        assert n == len(raw[i]) and spans == 1 and (removed == n if i in copies else size <= removed <= size + 60), (i, at, got[i])
    assert got[5000] == (1_000_000, 1_000_000, 1) and got[5001] == (200_000, 200_000, 1) and got[5002] == (399, 0, 0)


def test_equal_hashes_of_different_windows(monkeypatch):
    """Where hashes collide, bytes decide."""
    monkeypatch.setattr(substrings, "rolling", lambda data, width: np.zeros(max(0, len(data) - width + 1), np.uint64))
    a, b = bytes(range(200)) * 2, bytes(reversed(range(200))) * 2
    columns = tuple(np.array(x, np.int64) for x in ([7, 7, 7], [1, 2, 3], [0, 0, 0], [0, 0, 0], [1, 1, 1]))
    assert sorted(x[1] for x in substrings._settle(columns, [a, b, a])) == [1, 3]


def test_chunks_of_a_text_give_the_same_runs():
    raw = prose(8, 4000).encode()
    whole, parts = [np.concatenate(x) for x in zip(*substrings.all_runs(raw))], [np.concatenate(x) for x in zip(*substrings.all_runs(raw, 1000))]
    spread = lambda r: [(w, a, h) for f, l, a, h in zip(*r) for w in range(f, l + 1)]  # noqa: E731, E741
    assert spread(whole) == spread(parts)


def test_rolling_hash_and_runs():
    data = np.random.default_rng(0).integers(0, 3, 3000, dtype=np.uint8)
    for width in (1, 5, 128, 400):
        h = substrings.rolling(data, width)
        assert len(h) == len(data) - width + 1
        seen = defaultdict(set)
        for k in range(len(h)):
            seen[data[k : k + width].tobytes()].add(int(h[k]))
        assert all(len(v) == 1 for v in seen.values()) and len({x for v in seen.values() for x in v}) == len(seen)
    first, last, anchor, _ = substrings.runs(data)
    assert first[0] == 0 and last[-1] == 2600 and (first[1:] == last[:-1] + 1).all() and (anchor >= last).all()


# --- 10


def test_ids_equal_the_tokenizers_on_any_text():
    """White space, case, marks, ligatures, special tokens and a dotted capital I before punctuation, which becomes two characters."""
    from tokenizers import Tokenizer

    tok, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    assert tok.encode("BELED\u0130YES\u0130.", add_special_tokens=False).ids == np.frombuffer(words.text("BELED\u0130YES\u0130."), "<u4").tolist()
    rng, letters = random.Random(3), "abzAZ09 .,!?'-_()\"\u0130\u0131\u00df\u015e\u00c9\u00e9\u03a3\u03c3\u03c2\u2126\u00f1\u6f22\u5b57\ud55c\uae00\ufb01\u00b2\u00bd\u2167\u0327\u0301\u00a0\u200d\u2026\u201d\U0001f642\t\n\r <|>"
    for i in range(20_000):
        if i % 3:
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        else:
            text = "".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0x3000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0xE000, 0x10FFFF), 46, 32, 97])) for _ in range(rng.randint(1, 12)))
        assert tok.encode(text, add_special_tokens=False).ids == np.frombuffer(words.text(text), "<u4").tolist(), text


def test_remembered_words_are_bounded():
    """Many different words, with punctuation, capitals and letters beyond ASCII, leave twice the given number of words at most, and the ids are the tokenizer's."""
    from tokenizers import Tokenizer

    tok, words, rng = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path(), 300), random.Random(4)
    for _ in range(200):
        text = " ".join(rng.choice(["", "", "É", "ß", "N"]) + "".join(rng.choices("abcdefgß", k=rng.randint(1, 9))) + rng.choice(["", "", ",", ".", "###", "'s.", "9,", '").']) for _ in range(60))
        assert tok.encode(text, add_special_tokens=False).ids == np.frombuffer(words.text(text), "<u4").tolist(), text
        assert len(words) + len(words.old) <= 2 * 300 + packing.AT_ONCE * 4


def test_packing(docs_of):
    from tokenizers import Tokenizer

    rows = [(0, prose(70, 3000)), (1, None), (2, ""), (3, "Ünïcode <|endoftext|> it's don't... ***!! x_y_ 12.5 ΣΑΣ. \t\r\n\u00a0z"), (4, "word"), (4, "word"), (None, "a b c")]
    docs = docs_of(rows)
    got = packing.pack(docs, with_ids=True).toPandas()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    assert (got.length <= 4096).all() and all(n & (n - 1) == 0 for n in got.length) and got.sequence_id.is_unique and (got.offset == 0).all()
    for i, t in rows[:4]:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        p = got[got.doc_id == i].sort_values("start")
        assert b"".join(p.ids) == ids.tobytes() and (p.doc_tokens == len(ids)).all()
        assert p.start.tolist() == [0, *np.cumsum(p.length)[:-1]]
        assert p.ids_crc32.tolist() == [zlib.crc32(x) for x in p.ids]
    assert len(got[got.doc_id == 4]) == 2 * len(list(packing.pieces(2)))
    assert list(packing.pieces(4096 + 5)) == [(0, 4096), (4096, 4), (4100, 1)]
    empty_and_clashing(docs, packing.pack)
