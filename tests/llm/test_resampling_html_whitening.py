"""Importance resampling, wrapper induction and whitening against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from samplemill.llm import html_extraction, html_tree, near_dedup, ngram_lm, queries, resampling, whitening

DATA = "/root/testdata/sf0.001"


# resampling


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(resampling.UPPER, resampling.LOWER)))
    return words, Counter(zlib.crc32(" ".join(words[k : k + j]).encode()) % 100 for j in range(1, n + 1) for k in range(len(words) - j + 1))


def drawn(docs, target, n, least, percent):
    s, t = Counter(), Counter()
    for _, text in docs:
        s += features(text, n)[1]
    for text in target:
        t += features(text, n)[1]
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 100.0) / ((s[b] + 1) * (t.total() + 100.0)))) for b in range(100)]
    out = []
    for doc_id, text in docs:
        words, found = features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in found.items())
        out.append([doc_id, len(words), found.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    wide = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(wide[: percent * len(wide) // 100], 1):
        row[5] = rank
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_against_brute_force(spark, n):
    rng = np.random.default_rng(4)
    words = ["alpha", "Beta", "größe", "x9", "7", "日本", "é"]
    docs = [(k, " ,\n".join(rng.choice(words, rng.integers(0, 30)))) for k in range(80)]
    docs += [(None, "alpha beta " * 9), (90, None), (91, ""), (92, "..."), (93, "alpha " * 3000), (5, "alpha beta x9 x9 x9"), (94, "_alpha_beta")]
    target = ["beta beta x9 7", None, "", "alpha beta größe"]
    given = spark.createDataFrame([(d, t, 1, "n") for d, t in docs], "doc_id long, text string, n_words int, rank string").repartition(5)
    got = resampling.importance_resample(given, spark.createDataFrame([(t,) for t in target], "text string"), ngram=n, buckets=100, min_words=5, percent=40)
    rows = got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(list, rows), key=str) == drawn(docs, target, n, 5, 40)
    assert resampling.drawn_documents(given, got).count() == sum(r["rank"] is not None for r in rows)


def test_resampling_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert resampling.importance_resample(empty, some).count() == 0
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in resampling.importance_resample(some, empty, min_words=1, percent=100).collect()} == {(1, 3, 1), (2, 0, None)}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(resampling, "STEP_CHARS", 50)
    count = resampling.partition_counter(3, 100)
    texts = [" ".join(f"w{k % 17}" for k in range(400)), None, "a b", "x" * 300 + " y", "", "one two three four"]
    for text, (words, total, buckets, counts) in zip(texts, count(texts), strict=True):
        want = features(text, 3)
        assert words == len(want[0]) and total == want[1].total() and dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == want[1]
    whole = " ".join(f"w{k}" for k in range(300))
    assert len(list(resampling.pieces(whole, 3, 50))) > 20 and len(list(resampling.pieces("", 3, 50))) == 1


def tables():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def test_resampling_query_against_sql(spark):
    got = queries.op11_importance_resampling(spark, DATA)
    assert Counter(map(tuple, got.collect())) == Counter(tables().sql(resampling.ORACLE).fetchall())


# html


def texts_of(page):
    _, blocks = html_tree.read_page(page)
    return [blocks[k].text for k in html_tree.wanted_blocks(blocks)[0]]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []),
        ("plain &lt;text&gt; &amp; a < b\n c", ["plain <text> & a < b c"]),
        ("<p>one <b>two<br>three</b><p>four<ul><li>a<li>b</ul>five", ["one two three", "four", "a", "b", "five"]),
        ("<!-- <p>no</p> --><p title='a>b'>yes<!-- end", ["yes"]),
        ("<title>t</title><style>p{}</style><script>'</p>'</script><p>x</p><noscript>n</noscript>", ["x"]),
        ("<nav>n</nav><header>h</header><main><h1>T</h1><p>x</p><aside>s</aside><form>f<button>b</button></form></main><p>out</p><footer>f</footer>", ["T", "x"]),
        ("<article><header><h1>T</h1></header><p>x</p><div class='ad-box'>buy</div><section id=comments><article>c</article></section><article>reply</article></article>", ["T", "x"]),
        ("<body class='with-sidebar'><div class='sidebar-layout'><article><p>x</p></article></div></body>", ["x"]),
        ("<div class='cookieNotice'>c</div><div role=navigation>n</div><div class=shadow>kept</div>", ["kept"]),
        ("<p>a <span class=ad>buy <span>now</span></span> b</p>", ["a b"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after", ["deep", "after"]),
        ("<div class=leftSidebar>s</div><div id=page_footer2>f</div><div class=adbox1>a</div><div class=commentsArea>c</div><div class='loading comprehensive'>kept</div>", ["kept"]),
        ("<p>open <", ["open <"]),
        ("<p a=\"unclosed>text</p><p>more</p>", ["text", "more"]),
    ],
)
def test_reading_of_pages(page, texts):
    assert texts_of(page) == texts


def best_matching(a, b):
    """Simple tree matching by its definition, on [label, children]."""
    if a[0] != b[0]:
        return 0
    m = {(i, j): 0 for i in range(len(a[1]) + 1) for j in range(len(b[1]) + 1)}
    for i in range(1, len(a[1]) + 1):
        for j in range(1, len(b[1]) + 1):
            m[i, j] = max(m[i - 1, j], m[i, j - 1], m[i - 1, j - 1] + best_matching(a[1][i - 1], b[1][j - 1]))
    return 1 + m[len(a[1]), len(b[1])]


def test_tree_matching_and_merging():
    import json
    import random

    rnd = random.Random(1)

    def tree(depth):
        return [rnd.choice("abc"), [tree(depth - 1) for _ in range(rnd.randint(0, 3))] if depth else []]

    for _ in range(60):
        x, y = ["r", [tree(3) for _ in range(3)]], ["r", [tree(3) for _ in range(3)]]
        a, b = (html_tree.read_shape(json.dumps(t)) for t in (x, y))
        score = html_tree.matched(a, b, {})[0]
        assert score == best_matching(x, y)
        sizes = html_tree.size_of(a) + html_tree.size_of(b)
        html_tree.merge(a, b)
        assert html_tree.size_of(a) == sizes - score and a.pages == 2
        again = html_tree.read_shape(json.dumps(y))
        assert -1 not in html_tree.aligned(html_tree.numbered(a), again)  # each of its trees is in a wrapper
    root, _ = html_tree.read_page("<ul><li>a<li>b<li>c</ul><div><h2>x</h2><p>y</div><div><p>z</div>")
    assert html_tree.written_shape(html_tree.shape_of(root)[0]) == '["html",[["ul",[["flow",[]]]],["div",[["flow",[]]]]]]'


def page(k, article):
    links = "".join(f"<li><a href=/{j}>topic {k} {j}</a></li>" for j in range(2 + k % 4))
    main = f"<div class=c1><h1>Title {k}</h1><p>First words of text {k}, long enough to weigh more.</p><p>Subscribe now!</p><p>Second words {k} {'and so on ' * (3 + k % 3)}</p></div>"
    extra = f"<div class=x><p>Seen {k}</p></div>" if k % 3 == 0 else ""
    body = f"<article>{main}</article>" if article else main
    return f"<html><body><div class=t><ul>{links}</ul></div>{extra}{body}<div class=b>All rights kept</div></body></html>"


@pytest.mark.parametrize("article", [True, False])
def test_wrappers_of_hosts(spark, article):
    rows = [(k, f"http://H.example:80/{k}", page(k, article)) for k in range(12)]
    rows += [(100 + k, "http://h.example/copy", page(3, article)) for k in range(40)]  # copies say as much as one
    rows += [(200, "http://one.example/", page(7, article)), (201, None, "<p>no host</p>"), (202, "http://h.example/n", None), (203, "http://h.example/e", "")]
    df = spark.createDataFrame([(*r, "old", "x") for r in rows], "page_id long, url string, html string, text string, _host string").repartition(6)
    got = {r["page_id"]: r for r in html_extraction.extract_main_text(df).collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"page_id", "url", "_host", "text"} and got[0]["_host"] == "x"
    for k in range(12):
        want = [f"Title {k}", f"First words of text {k}, long enough to weigh more.", f"Second words {k} {'and so on ' * (3 + k % 3)}".strip()]
        assert got[k]["text"].split("\n") == want  # the line of all pages, the links and the foot are template or no content
    assert {got[100 + k]["text"] for k in range(40)} == {got[3]["text"]}
    assert "Subscribe now!" in got[200]["text"].split("\n") and got[201]["text"] == "no host" and got[202]["text"] == got[203]["text"] == ""


def test_pages_that_are_edits_of_one(spark):
    paragraphs = [f"Paragraph {j} of a text that many pages hold with small changes." for j in range(12)]
    rows = []
    for k in range(9):
        own = [*paragraphs[:k], f"Changed on page {k}.", *paragraphs[k + 1 :]]
        rows.append((k, "http://copies.example/", "<article><h1>One title</h1>" + "".join(f"<p>{x}" for x in own) + "</article>", "\n".join(["One title", *own])))
    got = html_extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, want string"))
    assert all(r["text"] == r["want"] for r in got.collect()) and got.count() == 9


def test_html_edges(spark):
    schema = "page_id long, url string, html string"
    assert html_extraction.extract_main_text(spark.createDataFrame([], schema)).count() == 0
    long = "<p>" + "</p><p>".join(f"paragraph {k} of many" for k in range(20_000)) + "</p>"
    got = html_extraction.extract_main_text(spark.createDataFrame([(1, "http://a.b/", long)] * 2, schema)).collect()
    assert [r["text"].count("\n") for r in got] == [19_999] * 2


def test_many_shapes_are_merged_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(html_extraction, "FAN", 3)
    names = "abcdefghij"
    rows = [("h", f'["html",[["{x}",[]],["{y}",[]]]]', k + 1) for k, (x, y) in enumerate((a, b) for a in names for b in names if a < b)]
    got = html_extraction.induced_wrappers(spark.createDataFrame(rows, "host string, shape string, pages long")).collect()
    assert len(got) == 1 and got[0]["pages"] == sum(r[2] for r in rows)
    wrapper = html_tree.numbered(html_tree.read_shape(got[0]["shape"]))
    assert all(-1 not in html_tree.aligned(wrapper, html_tree.read_shape(r[1])) for r in rows)


def test_html_query_keeps_whole_articles(spark):
    import html

    for r in queries.op12_html_extraction(spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>|</?b>", " ", x) if "<br>" in x else re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# whitening

VECTORS = "vec_id long, embedding array<float>, n string, white int"


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 5).astype(np.float32)
    rows = [(k, [float(c) for c in v], "n", 0) for k, v in enumerate(vectors)]
    odd = [(900, None, "n", 0), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], "n", 0), (902, [float("nan")] * 6, "n", 0), (903, [float("inf")] * 6, "n", 0), (904, [], "n", 0), (905, [1.0, 2.0], "n", 0)]
    again = [(0, rows[0][1], "n", 0), (None, rows[1][1], "n", 0)]
    got = whitening.whitened_rows(spark.createDataFrame(rows + odd + again, VECTORS).repartition(7), components=4).toPandas()
    x = np.array([[math.floor(c * 64) + 1_000_000 for c in v] for _, v, _, _ in rows + again], np.int64)
    n, sums = len(x), x.sum(axis=0)
    values, right = np.linalg.eigh(np.cov(x.T, bias=True))
    values, right = values[::-1], right[:, ::-1]
    want = (x - sums / n) @ right / np.sqrt(values)
    assert len(got) == n * 4 and set(got["n"]) == {n} and "white" in got and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    for k in (0, 17, 299):
        own = got[got["vec_id"] == k].sort_values("component").drop_duplicates("component")
        assert np.allclose(np.abs(own["whitened"]), np.abs(want[k][:4]), atol=1e-9) and np.allclose(own["explained"], (values / values.sum())[:4], rtol=1e-9)
        assert {int(d) for d in own["deviation"]} == {sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums, strict=True))}
    one = got[got["vec_id"] == 5].sort_values("component")["whitened"].to_numpy() * np.sign(want[5][:4])
    two = got[got["vec_id"] == 6].sort_values("component")["whitened"].to_numpy() * np.sign(want[5][:4])
    assert np.allclose(one * two, want[5][:4] * want[6][:4] * np.sign(one) * np.sign(want[5][:4]), atol=1e-9)  # one sign for all rows


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[], []]])
def test_whitening_without_variance(spark, vectors):
    df = spark.createDataFrame([(k, v, "", 0) for k, v in enumerate(vectors)], VECTORS)
    model = whitening.fit_whitening(df)
    assert len(model.components) == 0 and whitening.whitened_rows(df).count() == 0
    assert whitening.whiten(df, model).count() == (len([v for v in vectors if v]))


def test_whitening_of_fewer_directions_and_of_great_numbers(spark):
    line = [[float(k), 2.0 * k, 7.0] for k in range(40)]
    model = whitening.fit_whitening(spark.createDataFrame([(k, v, "", 0) for k, v in enumerate(line)], VECTORS))
    assert len(model.components) == 1 and np.allclose(model.explained, 1)
    far = whitening.scaled_deviations(np.array([[1 << 40, 3], [5, 6]]), 1 << 30, np.array([1 << 50, 1 << 49], object))
    assert far.dtype == object and far[0, 0] == (1 << 70) - (1 << 50) and whitening.squared_lengths(far)[0] == ((1 << 70) - (1 << 50)) ** 2 + ((3 << 30) - (1 << 49)) ** 2
    assert whitening.squared_lengths(np.array([[3, 4]])) == [25]


# near dedup and n-gram counts


def test_near_dedup_of_families_and_repeated_rows(spark):
    import random

    rnd, rows = random.Random(5), []
    for family in range(8):
        base = [f"w{family}x{rnd.randrange(10**6)}" for _ in range(120)]
        for version in range(5):
            words = list(base)
            if version:
                words[rnd.randrange(120)] = f"edit{version}"
            rows.append((family * 5 + version, " ".join(words)))
    base = [f"q{k}" for k in range(100)]
    edited = [*base[:50], "zz", *base[51:]]
    rows += [(100, " ".join(base))] * 2 + [(101, " ".join(edited))] * 2
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == Counter(con.sql(near_dedup.ORACLE).fetchall())


def test_near_dedup_reads_one_set_a_class(spark):
    base = [f"q{k}" for k in range(100)]
    texts = [" ".join(base), " ".join([*base[:50], "zz", *base[51:]])]
    docs = spark.createDataFrame([(None, t) for t in texts for _ in range(300)] + [(7, texts[0])], "doc_id long, text string")
    signed = near_dedup.document_sets(docs)
    from pyspark.sql import functions as F

    members = signed.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    assert near_dedup._class_sets(docs, members, 5).count() == 2
    got = near_dedup.near_duplicates(docs).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, 7), (7, 7)} and len(got) == 601
    assert near_dedup.drop_near_duplicates(docs).collect()[0]["doc_id"] == 7


def test_recall_of_pairs_near_the_threshold(spark):
    rng, rows, linked = np.random.default_rng(12), [], 0
    for pair in range(400):
        words = [f"p{pair}w{k}" for k in range(300)]
        other = list(words)
        for at in rng.choice(300, int(rng.integers(3, 8)), replace=False):
            other[at] = f"e{pair}x{at}"
        a, b = near_dedup.shingle_set(" ".join(words)), near_dedup.shingle_set(" ".join(other))
        shared = len(np.intersect1d(a, b))
        near = 100 * shared >= 85 * (len(a) + len(b) - shared)
        linked += near
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert linked > 100 and sum(got[2 * k + 1] == 2 * k for k in range(400)) == linked


def test_counts_beyond_32_bits(tmp_path):
    grams, counts = np.array([[0, 0], [0, 1], [1, 0]], np.uint64), np.array([2**33 + 5, 1, 7])
    folder = f"file://{tmp_path}"
    ngram_lm.write_grams(folder, 2, 0, grams, counts)
    ngram_lm.write_atomically(f"{folder}/present-2", [b"\1"])
    model = ngram_lm.NgramModel(folder, 2, 1, 2, 10, 1, ((0.5, 1.0, 1.5),) * 2, (1, 1, 1), 3)
    count, total, left = model.gram_values(grams)
    assert count.tolist() == counts.tolist() and total.tolist() == [2**33 + 6] * 2 + [7] and left.tolist() == [2.0, 2.0, 1.5]
    assert ngram_lm.unpack_counts(ngram_lm.pack_counts(counts)).tolist() == counts.tolist()
