"""The operators against brute force, exact round trips and hidden labels, and their edge cases."""

import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from samplemill.llm import chat, common, decontamination, language_id, line_dedup, media, near_dedup, ngram_lm, packing, token_files, tokens, warc

SCHEMA = "doc_id long, text string, source string, n_lines long, _gone long"
LONG = " ".join(f"word{k}" for k in range(30_000))
EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "same text here for all of us"), (6, "same text here for all of us"), (6, "same text here for all of us"), (None, "no id at all"), (7, LONG), (8, None)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(d, t, "s", 1, 2) for d, t in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_gives_the_librarys_ids(name):
    import random

    rnd, t, e = random.Random(3), library(name), tokens.ChunkEncoder(tokens.public_path(name), memo_chunks=300)
    parts = ["the", "The,", "Éa.", "x9", "don't", "ß", "İx", "1.5", "...", "(a)", "日本", "é,", "à", "​", "<|endoftext|>"]
    gaps = [" ", " ", " ", "\n", "  ", "\n\n", "\t", "\r\n", " \n", "\x1c", "\x85", "\xa0", ""]
    texts = ["".join(rnd.choice(parts) + rnd.choice(gaps) for _ in range(rnd.randint(0, 9))) for _ in range(4000)]
    want = [np.asarray(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]
    assert e.encode_all(texts) == want


def test_a_worker_keeps_one_memo():
    enc = tokens.encoder(tokens.public_path("byte_bpe_50k.json"))
    ids = enc.encode("one two three")
    assert enc.memo and tokens.encoder(tokens.public_path("byte_bpe_50k.json")).memo
    common.use_memo("near_dedup", near_dedup.forget_words)
    near_dedup.shingle_set("one two three four five six")
    assert not enc.memo and near_dedup._word_hashes
    common.use_memo("decontamination", decontamination.forget_words)
    decontamination.template("one two three")
    assert not near_dedup._word_hashes and decontamination._vocabulary.rows
    enc = tokens.encoder(tokens.public_path("byte_bpe_50k.json"))
    assert not decontamination._vocabulary.rows and enc.encode("one two three") == ids


def test_packing(edges, empty):
    t = library("byte_bpe_50k.json")
    got = packing.pack_documents(edges, group_pieces=4).toPandas()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 2048 and list(s["offset"]) == [0, *s["length"].cumsum()[:-1]]
    for doc_id, text in {(d, t) for d, t in EDGES}:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got["doc_id"].isna() if doc_id is None else got["doc_id"] == doc_id]
        assert len(own.drop_duplicates("start")) == -(-len(ids) // 2048) and set(own["doc_tokens"]) == {len(ids)}
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert (got["doc_id"] == 6).sum() == 2 and packing.pack_documents(empty).count() == 0


def test_first_fit_decreasing_is_first_fit():
    lengths = np.random.default_rng(2).integers(1, 100, 400)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room = []
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        room += [100] * (b == len(room))
        assert bins[i] == b and offsets[i] == 100 - room[b]
        room[b] -= lengths[i]


def components(texts, percent=85):
    lower = {k: k + 32 for k in range(65, 91)}
    words = {d: [w.translate(lower) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for d, t in texts.items()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    found = {d: d for d in texts}

    def root(d):
        return d if found[d] == d else root(found[d])

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                found[y] = x
    return {d: (len(sets[d]), root(d)) for d in texts}


def test_near_dedup_against_all_pairs(spark):
    import random

    rnd, texts = random.Random(8), {}
    base = [rnd.choice("abcdefghijklmnopq") + str(rnd.randint(0, 40)) for _ in range(260)]
    for d in range(120):  # variants of one text, with few to many edits, and texts apart
        words = list(base) if d % 4 else [f"own{d}x{k}" for k in range(50)]
        for _ in range(rnd.randint(0, 12) * (d % 4)):
            words[rnd.randrange(len(words))] = f"e{rnd.randint(0, 300)}"
        texts[d] = " ".join(words)
    texts |= {200: "One Two", 201: "one two", 202: "", 203: None, 204: " \n", 205: texts[1]}
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup_edges(edges, empty):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(edges).collect()]
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 3, 5, True), (6, 3, 5, False), (None, 1, None, True)} <= set(got) and len(got) == len(EDGES)
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_duplicates(edges).columns == edges.columns


def test_block_comparison_is_exact():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.int64)) for _ in range(30)]
    got = near_dedup.shared_counts(sets[:18], sets[18:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[18:]] for a in sets[:18]]


def test_line_dedup(spark, edges, empty):
    run = "\n".join(" ".join(f"w{k}{j}" for j in range(18)) for k in range(4))
    rows = [(1, f"first\n{run}\nlast"), (2, f"other head\n{run}\n\nother tail"), (3, "first\nlast"), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "other head\n\nother tail" and got[2]["removed_runs"] == "1-4"
    assert got[3]["text"] == "first\nlast" and got[4]["text"] is None and got[4]["n_lines"] == 0 and got[5]["text"] == ""
    assert line_dedup.dedup_lines(edges).count() == len(EDGES) and line_dedup.dedup_lines(empty).count() == 0


def test_token_files(edges, empty):
    rng = np.random.default_rng(1)
    ranks = np.concatenate([rng.integers(0, 2**k, 50) for k in (8, 16, 24, 32)]).astype(np.uint32)
    assert (token_files.unpack_codes(*token_files.pack_codes(ranks), len(ranks)) == ranks).all()
    t, at = library("word_bpe_49k.json"), 0
    got = token_files.read_token_files(token_files.write_token_files(edges, files=3)).orderBy("start").collect()
    texts = {d: x for d, x in EDGES}
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in EDGES), key=lambda d: -1 if d is None else d)
    for r in got:
        ids = [*t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(empty)).count() == 0


def test_media(spark, edges):
    folder = media.store_texts(edges)
    got = media.load_media(spark, folder, range_bytes=4000).collect()
    want = sorted((d or -1, *media.payload_of(t)) for d, t in EDGES)
    assert sorted((r["doc_id"] or -1, bytes(r["payload"]), r["n_bytes"]) for r in got) == want
    assert all(media.decode_image(bytes(r["media"])) == (bytes(r["payload"]), r["n_bytes"]) for r in got)
    assert len({r["feature"] for r in got if r["doc_id"] in (5, 6)}) == 1


def test_members_are_retried_by_offset(tmp_path):
    import io
    import zipfile

    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one", b"payload")
    info = zipfile.ZipFile(path).infolist()[0]

    class Broken(io.BytesIO):
        def read(self, *_):
            raise OSError("lost")

    assert media.read_member(path, Broken(), info, wait_s=0)[0] == b"payload"
    with pytest.raises(OSError):
        media.read_member(str(tmp_path / "none.zip"), Broken(), info, attempts=1, wait_s=0)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = language_id.learn_dictionaries(language_id.training_rows(docs))
    assert set(learned) == {"en", "de", "fr", "es"} and all(len(v) <= language_id.DICTIONARY_BYTES for v in learned.values())
    held = language_id.identify_languages(docs.filter(language_id.remainder(F.col("doc_id"), 4) == 2), learned).toPandas()
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and held["score"].between(0, 1).all() and held["rejected"].mean() < 0.03


def test_language_id_edges(edges, empty):
    none = language_id.learn_dictionaries(empty.withColumn("lang", F.lit("x")))
    assert none == {}
    got = {r["doc_id"]: r for r in language_id.identify_languages(edges, {"en": b"same text here", "fr": b"autre chose"}).collect()}
    assert got[1]["lang_pred"] == got[3]["lang_pred"] == "und" and got[5]["lang_pred"] == "en" and got[1]["rejected"]


@pytest.mark.parametrize("order,shard_tokens,fan", [(2, 7, 64), (3, 7, 64), (4, 7, 2), (2, 5, 2), (3, 1000, 64)])
def test_ngram_model_sums_to_one_and_matches_brute_force(spark, empty, edges, monkeypatch, order, shard_tokens, fan):
    import math
    from collections import Counter

    monkeypatch.setattr(ngram_lm, "FAN", fan)
    monkeypatch.setattr(ngram_lm, "RUN_TOKENS", 12)
    texts = ["a b c a b", "a b d", "c a b", "A b c d e f", "d d d d d", "b a", "", None, "e f a", "g h", "g i", "a b c a b", "x a b c a b d", "y a b c a b e"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = ngram_lm.train(df, shard_tokens=shard_tokens, order=order)
    seqs = [[*(t or "").lower().split(), None] for t in texts]
    c = Counter(w for s in seqs for w in s)
    # counts of each order: raw for the highest and at the start of a text, else different words before
    counts = {order: Counter(tuple(s[k : k + order]) for s in (["<s>", *x] for x in seqs) for k in range(len(s) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
        if k > 1:
            counts[k] += Counter(tuple(["<s>", *s][:k]) for s in seqs if len(s) >= k - 1)
    assert [len(d) for d in model.discounts] == [3] * order and model.types == len(counts[2])

    def p(history, w):
        out, d = 1 / (len(c) + 1), model.discounts[0]
        total = sum(counts[1].values())
        own = counts[1][w,]
        out = (own - (d[min(own, 3) - 1] if own else 0) + sum(d[min(n, 3) - 1] for n in counts[1].values()) * out) / total
        for k in range(2, order + 1):
            if len(history) < k - 1:
                break
            h, d = tuple(history[-(k - 1) :]), model.discounts[k - 1]
            after = {g[-1]: n for g, n in counts[k].items() if g[:-1] == h}
            if after:
                own = after.get(w, 0)
                out = (own - (d[min(own, 3) - 1] if own else 0) + sum(d[min(n, 3) - 1] for n in after.values()) * out) / sum(after.values())
        return out

    for history in (["<s>"], ["<s>", "a"], ["c", "a", "b"], ["zz", "a"]):
        assert sum(p(history, w) for w in c) + p(history, "unknown") == pytest.approx(1)
    more = df.union(spark.createDataFrame([(99, "zz a yy b a b c")], "doc_id long, text string"))
    for r in ngram_lm.score_documents(more, model).collect():
        s = ["zz", "a", "yy", "b", "a", "b", "c", None] if r["doc_id"] == 99 else seqs[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(math.log10(p(["<s>", *s[:k]], w)) for k, w in enumerate(s)))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (sum(c.values()) + 0.1 * (len(c) + 1))) for w in s))
        assert (r["n_tokens"], r["n_known"]) == (len(s), sum(w in c for w in s))
    if order == 2:
        nothing = ngram_lm.train(empty)
        assert nothing.words == 0 and ngram_lm.score_documents(edges, nothing).count() == len(EDGES) and ngram_lm.score_documents(empty, model).count() == 0


def test_decontamination(spark, edges, empty):
    question = "A farmer sells 12 apples and 7 pears to Maria at the market for 3 dollars each morning, and keeps 12 apples at home."
    changed = question.replace("12", "45").replace("7", "9").replace("Maria", "Peter")
    torn = question.replace("12 apples and", "45 apples and").replace("Maria", "Peter").replace("keeps 12", "keeps 46").replace("7", "12")
    bench = spark.createDataFrame([(1, question), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Intro here. {question} More."), (2, f"Then: {changed}"), (3, "A farmer sells many things to all people at the market."), (4, torn), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_contamination(docs, bench).collect()}
    assert {1, 2} <= set(got) and 3 not in got and not got[1]["reparameterised"] and got[2]["reparameterised"]
    assert decontamination.find_contamination(edges, bench).count() == 0 and decontamination.find_contamination(empty, bench).count() == 0
    assert decontamination.drop_contaminated(edges, bench).count() == len(EDGES)


def test_warc(spark):
    page = '<html lang="de"><head><title>A &amp; B</title><script>x("</p>")</script></head><body><p>One &lt; two</p><!-- no --><div>Three<br>four <a href="/x?a=1&amp;b=2">link</a></div></body></html>'
    pages = spark.createDataFrame([(1, "http://a/b", page), (2, None, None), (None, "http://c", "")], "page_id long, url string, html string")
    rows = warc.build_derivatives(warc.build_responses(pages)).collect()
    assert len(rows) == 6
    text, meta = sorted((r for r in rows if r["source_id"] == 1), key=lambda r: r["warc_type"])
    assert text["block"] == "One < two\nThree\nfour link"
    assert "title: A & B\r\n" in meta["block"] and "outlink: /x?a=1&b=2\r\n" in meta["block"] and "language: de\r\n" in meta["block"]
    source, _ = warc.parse_record(warc.response_record("http://a/b", 1, page))
    for r in (text, meta):
        headers, block = warc.parse_record(bytes(r["record"]))
        assert headers["warc-refers-to"] == source["warc-record-id"] == r["refers_to"] and warc.digest(block) == headers["warc-block-digest"]
        assert r["source_payload_digest"] == source["warc-payload-digest"]
    assert text["concurrent_to"] == meta["record_id"]
    files = warc.write_warc(warc.build_derivatives(warc.build_responses(pages))).collect()
    import gzip

    found = [x for f in files for x in warc.parse_all(gzip.open(f["path"].removeprefix("file:")).read())]
    assert sorted(found) == sorted(bytes(r["record"]) for r in rows)


def test_chat_roles(spark, empty):
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    raw = chat.raw_transcripts(conversations)
    held_out = language_id.remainder(F.col("transcript"), 4) == 2
    model = chat.learn_turns(raw.filter(~held_out))
    whole = chat.recover_roles(raw.filter(held_out), model).toPandas()
    truth = raw.toPandas().merge(whole, on=["transcript", "turn", "part"], suffixes=("", "_found"))
    assert len(truth) == len(whole) and (truth["role"] == truth["role_found"]).mean() > 0.9
    assert chat.without_marker("### Human", True) == "" and chat.without_marker("User: hi", True) == "hi" and chat.without_marker("Note: hi", True) == "Note: hi"
    lines = spark.createDataFrame([(1, 0, 0, "User: hi"), (1, 1, 0, "Assistant: yes"), (1, 1, 1, None), (None, None, None, ""), (None, 3, None, LONG)], "transcript long, turn long, part long, line string")
    found = chat.recover_roles(lines.withColumn("block", F.lit("x")), model).collect()
    assert sorted((r["transcript"] or 0, r["at"]) for r in found) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]
    known = spark.createDataFrame([(1, 0, 0, "user", True, "hi "), (1, 1, 1, "assistant", True, "<|x|>"), (1, 2, 1, "assistant", False, "more")], "transcript long, at long, turn_no long, role string, opens boolean, content string")
    turns = chat.render_turns(known).orderBy("turn_no").collect()
    assert [r["rendered"] for r in turns] == ["<|user|>\nhi<|end|>\n", "<|assistant|>\n<x>\nmore<|end|>\n"]
    assert chat.recover_roles(lines.limit(0), model).count() == 0 and chat.render_turns(known.limit(0)).count() == 0
    assert np.allclose(np.exp(chat.learn_turns(raw.limit(0)).shows[0]), 1 / chat.SIZES[0])


def turn_model(seed=7):
    rng = np.random.default_rng(seed)
    log = lambda *s: np.log(rng.dirichlet(np.ones(s[-1]), s[:-1] or None))
    return chat.TurnModel(log(chat.STATES), log(chat.STATES, chat.STATES), tuple(log(chat.STATES, n) for n in chat.SIZES))


LINES = ["User: a b?", "x.", "Assistant: c", "", "d e f g h", None]


def test_viterbi_is_the_best_of_all_paths():
    import itertools
    import random

    rnd, model = random.Random(4), turn_model()
    texts = [[rnd.choice(LINES) for _ in range(n)] for n in (3, 1, 5, 4, 1, 5, 2)]
    shown = model.emissions([x for t in texts for x in t])
    begins = np.cumsum([0, *map(len, texts[:-1])])
    parts = chat.Parts(begins, len(shown))
    k = len(begins)
    found = model.paths(shown, parts, np.ones(k, bool), np.full(k, -1), np.full(k, -1))
    best, turns = model.matrices(shown, parts, np.ones(k, bool))
    for text, begin in zip(texts, begins):
        n, row = len(text), int(np.flatnonzero(parts.begins == begin)[0])
        score = lambda p: model.start[p[0]] + shown[begin, p[0]] + sum(model.step[a, b] + shown[begin + t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:])))
        path = max(itertools.product(range(chat.STATES), repeat=n), key=score)
        assert tuple(found[begin : begin + n]) == path
        assert best[row, 0].max() == pytest.approx(score(path)) and turns[row, 0, path[-1]] == sum(s % 2 == 0 for s in path)


def test_transcripts_over_many_blocks(spark):
    import random

    rnd, model = random.Random(5), turn_model(3)
    rows = [(7 if k % 3 else k % 11 + 100, k // 5, k % 5, rnd.choice(LINES), rnd.choice(["user", "assistant", "system", "else", None])) for k in range(600)] + [(None, 1, k, "z", "user") for k in range(40)]
    lines = spark.createDataFrame(rows, "transcript long, turn long, part long, line string, role string")
    results, models = [], []
    was = spark.conf.get("spark.sql.shuffle.partitions")
    for n, batch in (("1", "10000"), ("37", "5")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        models.append(chat.learn_turns(lines))
        results.append(chat.recover_roles(lines, model).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for r in results:
        assert sorted(zip(r["transcript"].fillna(-1), r["at"])) == [(t, k) for t, n in sorted(r["transcript"].fillna(-1).value_counts().items()) for k in range(n)]
    for transcript in (-1, 7, 105):
        scores = []
        for r in results:
            own = r[r["transcript"].fillna(-1) == transcript].sort_values("at")
            shown = model.emissions(own["line"].tolist())
            path = [2 * chat.ROLES.index(x) + (not o) for x, o in zip(own["role"], own["opens"])]
            scores.append(model.start[path[0]] + shown[0, path[0]] + sum(model.step[a, b] + shown[k + 1, b] for k, (a, b) in enumerate(zip(path, path[1:]))))
            assert list(own["turn_no"]) == list(np.cumsum(own["opens"]) - 1)
        assert scores[0] == pytest.approx(scores[1])  # the same best score; paths with equal scores can differ
    # counts by brute force
    known = sorted(((t is not None, t or 0, turn, part, line is not None, line or "", role) for t, turn, part, line, role in rows if role in chat.ROLES), key=lambda r: r[:6])
    step, start = np.ones((chat.STATES, chat.STATES)), np.ones(chat.STATES)
    states = [2 * chat.ROLES.index(r[6]) + (r[3] > 0) for r in known]
    for k, s in enumerate(states):
        if k and known[k - 1][:2] == known[k][:2]:
            step[states[k - 1], s] += 1
        else:
            start[s] += 1
    allowed = [[t % 2 == 0 or t // 2 == s // 2 for t in range(chat.STATES)] for s in range(chat.STATES)]
    step, start = np.where(allowed, step, 1e-9), np.where(np.arange(chat.STATES) % 2 == 0, start, 1e-9)
    for m in models:
        assert np.allclose(m.step, np.log(step / step.sum(axis=1, keepdims=True))) and np.allclose(m.start, np.log(start / start.sum()))


def test_queries_and_pipeline(spark):
    import corpus_pipeline

    from samplemill.llm.queries import ORACLES, QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    con, data = duckdb.connect(), "/root/testdata/sf0.001"
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, data)
        want = con.sql(sql).df()[df.columns].sort_values(df.columns[0], ignore_index=True)
        pd.testing.assert_frame_equal(df.toPandas().sort_values(df.columns[0], ignore_index=True), want, check_dtype=False)
    docs = corpus_pipeline.read_table(spark, data, "documents")
    t = library("byte_bpe_50k.json")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, data), "test")
        if name == "near dedup":  # the stage alone against all pairs
            want = components({r["doc_id"]: r["text"] for r in before.collect()}, 80)
            assert {r["doc_id"] for r in docs.collect()} == {d for d, (_, c) in want.items() if d == c}
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    got = docs.toPandas()
    assert set(got["doc_id"]) == set(texts)
    for d, own in got.groupby("doc_id"):
        assert own["length"].sum() == len(t.encode(texts[d] or "", add_special_tokens=False).ids) + 1


def test_near_stage_against_all_pairs_at_80(spark):
    import corpus_pipeline

    texts = {}
    for d in range(12):  # pairs of 96 shingles: an edit in the middle costs five of them
        words = [f"t{d}w{k}" for k in range(100)]
        texts[2 * d] = " ".join(words)
        for e in range(d % 4):
            words[20 + 20 * e] = f"edit{e}"
        texts[2 * d + 1] = " ".join(words)
    want = {p: {d for d, (_, c) in components(texts, p).items() if d == c} for p in (80, 85)}
    assert len(want[80]) < len(want[85]) < len(texts)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_stage(spark, docs, "")
    assert {r["doc_id"] for r in got.collect()} == want[80]


def test_decontamination_of_other_case_and_short_items(spark):
    question = "Every spring Maria Lopez takes 12 wooden boats from Lake Como to Uncle Henry and Aunt Rosa, who paint Maria's boats blue near Bern in 3 days."
    short = ["Yes.", "Maria Lopez", "So it is 7.", "One plain question in six words"]
    bench = spark.createDataFrame([(1, question), *enumerate(short, 2)], "item_id long, text string")
    copies = [question, question.upper(), question.lower(), question.title(), question.upper().replace("12", "45")]
    docs = [*enumerate(f"Some words before. {c} And after." for c in copies), (10, "Yes. Maria Lopez said so. So it is 7. Good."), (11, "ONE PLAIN QUESTION IN SIX WORDS")]
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(0, 1): False, (1, 1): False, (2, 1): False, (3, 1): False, (4, 1): True, (11, 5): False}


def test_language_samples_are_whole(spark):
    import random

    rnd = random.Random(5)
    rows = [("long", " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(40_000)))]  # one line that exceeds a dictionary
    rows += [("copies", "the same text")] * 3000 + [("copies", f"own text {k}") for k in range(300)]
    rows += [(f"rare{k}", f"rare {k}") for k in range(250)]
    learned = language_id.learn_dictionaries(spark.createDataFrame(rows, "lang string, text string"), sample_documents=50)
    assert set(learned) == {lang for lang, _ in rows} and next(iter(learned)) == "copies"
    assert 40_000 < len(learned["long"]) <= language_id.DICTIONARY_BYTES
    # digits count as blanks
    assert learned["copies"].count(b"own text") >= 49
    small = language_id.learn_dictionaries(spark.createDataFrame(rows, "lang string, text string"), sample_documents=50, total_bytes=252 * 5000)
    assert set(small) == set(learned) and len(small["long"]) <= 5000


def test_one_language_rejects_no_text(spark):
    text = "".join(chr(97 + int(k)) for k in np.random.default_rng(6).integers(0, 26, 60_000))
    assert language_id.classify(text, (("en", b"some words"),)) == ("en", 1.0, False)
    assert language_id.classify("12", (("en", b"some words"),))[2]


def test_drops_judge_each_row(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(1, text("a")), (None, text("a") + " end"), (None, text("b")), (3, text("a")), (3, text("c")), (4, text("d")), (4, text("d")), (4, text("d") + " end"), (None, text("e")), (None, text("e")), (None, text("e") + " end"), (5, ""), (5, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, _gone long")
    out = near_dedup.drop_near_duplicates(docs)
    got = [(r["doc_id"], (r["text"] or "")[:1]) for r in out.collect()]
    assert out.columns == docs.columns
    assert sorted(got, key=str) == sorted([(1, "a"), (None, "b"), (3, "c"), (4, "d"), (None, "e"), (5, ""), (5, ""), (None, "")], key=str)
    bench = spark.createDataFrame([(1, "one question that someone asks about boats on the lake today")], "item_id long, text string")
    held = bench.first()["text"]
    rows = [(None, held), (None, "clean"), (7, held), (7, "clean"), (8, None), (None, None)]
    out = decontamination.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, "clean"), (7, "clean"), (8, None), (None, None)], key=str)


def test_a_rest_of_white_space_is_no_document(spark):
    import corpus_pipeline

    text = "\n\n" + "\n".join(" ".join(f"w{k}{j}" for j in range(18)) for k in range(4)) + "\n\n"
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in [(1, text), (2, text), (3, text + "more"), (4, "\n\n")]], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.line_stage(spark, docs, "").collect()) == [1, 3, 4]


def test_media_writes_add_up_and_replace(spark, edges, tmp_path):
    folder = "file://" + str(tmp_path / "media")
    one, two = edges.filter("doc_id = 4"), edges.filter("doc_id in (5, 7)")
    media.store_texts(one, folder)
    media.store_texts(two, folder)
    assert sorted(r["doc_id"] for r in media.load_media(spark, folder).collect()) == [4, 5, 7]
    # archives of a write that wasn't committed aren't read, nor does one attempt of a task stand in for another
    (tmp_path / "media" / f"archive-{'0' * 32}-000000-{'1' * 8}-0000.zip").write_bytes(b"half")
    assert media.load_media(spark, folder).count() == 3
    rows = spark.createDataFrame([("x/9.png", media.encode_image(*media.payload_of("nine")))], "name string, media binary")
    rows.write.format("media_archive").mode("overwrite").save(folder)
    assert [r["doc_id"] for r in media.load_media(spark, folder).collect()] == [9]
    assert media.load_media(spark, media.store_texts(edges.limit(0))).count() == 0


def test_packing_repeats_and_keys(spark):
    rows = [(1, "a b c")] * 700 + [(None, None)] * 500 + [(2, LONG)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, group_pieces=64, keep_ids=True)
    assert got.filter("doc_id = 1").count() == 700 and got.filter("doc_id is null").count() == 500
    again = packing.pack_documents(docs.repartition(7), group_pieces=64, keep_ids=True)
    assert got.exceptAll(again).isEmpty() and again.exceptAll(got).isEmpty()
    full = packing.sequences(got, pad_id=7).toPandas()
    want = library("byte_bpe_50k.json").encode("a b c", add_special_tokens=False).ids + [1]
    for s in full.itertuples():
        ids, at = list(s.ids), 0
        assert len(ids) in (2048, sum(s.segment_lengths)) and all(x == 7 for x in ids[sum(s.segment_lengths) :])
        for n, d in zip(s.segment_lengths, s.doc_ids):
            assert d != 1 or ids[at : at + n] == want
            at += n
    assert packing.sequences(got.limit(0)).count() == 0


def _record(http: bytes, kind="response", length=None, extra=()):
    return warc.record_bytes([("WARC-Type", kind), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a/"), ("WARC-Date", warc.DATE), *extra], http)


def test_warc_headers_codings_and_bad_records(spark, empty):
    import gzip
    import zlib as z

    page = b"<html lang='de'><head><title>T &amp; U</title></head><body><p>one</p>two<!-- no --><script>x</script></body>"
    chunked = b"5\r\n" + page[:5] + b"\r\n" + b"%x;x=1\r\n" % (len(page) - 5) + page[5:] + b"\r\n0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nContent-Type: text/html\r\n"
    bodies = {b"": page, b"Content-Encoding: gzip\r\n": gzip.compress(page), b"Content-Encoding: deflate\r\n": z.compress(page), b"Transfer-Encoding: chunked\r\n": chunked, b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n": None, b"Content-Encoding: br\r\n": page, b"Content-Encoding: gzip \r\n": page}
    zipped = gzip.compress(page)
    bodies[b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n"] = b"%x\r\n" % len(zipped) + zipped + b"\r\n0\r\n\r\n"
    good = [_record(head + k + b"\r\n" + b) for k, b in bodies.items()]
    long = _record(head + b"\r\n" + b"<!--<script><a " * 50_000)
    bad = [b"", b"junk", b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx", good[0][: len(good[0]) // 2], None]
    others = [_record(b"GET / HTTP/1.1\r\n\r\n", "request"), _record(b"", "warcinfo")]
    rows = [(k, r) for k, r in enumerate([*good, good[0], long, *bad, *others])]
    responses = spark.createDataFrame(rows, "source_id long, record binary")
    found = warc.build_derivatives(responses).toPandas()
    assert set(found["source_id"]) == set(range(len(good) + 2)) and len(found) == 2 * (len(good) + 2)
    texts = found[(found["warc_type"] == "conversion") & (found["source_id"] <= len(good))]
    assert set(texts["block"]) == {"one\ntwo"}
    meta = found[(found["warc_type"] == "metadata") & (found["source_id"] == 0)]["block"].iloc[0]
    assert "http-set-cookie: a=1\r\nhttp-set-cookie: b=2\r\n" in meta and "title: T & U\r\nlanguage: de\r\n" in meta
    reasons = {r["source_id"]: r["reason"] for r in warc.unreadable_records(responses).collect()}
    assert set(reasons) == set(range(len(good) + 2, len(good) + 2 + len(bad)))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.build_derivatives(warc.build_responses(none)).count() == 0 and warc.unreadable_records(responses.limit(0)).count() == 0
    files = warc.write_warc(warc.build_derivatives(responses)).collect()
    assert sum(r["n_records"] for r in files) == len(found)


def test_clashing_names_stay(spark):
    names = ("_found", "_text_hash", "_text_key", "_key", "_held", "_runs", "_row_doc", "_row_text", "_id", "_hash", "_stays", "stays", "n", "block", "key", "range", "kind", "group", "set_key")
    docs = spark.createDataFrame([(1, "the cat sat", *names), (2, "the cat sat", *names), (2, "a dog ran off", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, "the cat sat on the mat with the hat")], "item_id long, text string").withColumn("_key", F.lit(1))
    for out, rows in (
        (language_id.identify_languages(docs, {"en": b"the cat sat on the mat"}), 3),
        (line_dedup.dedup_lines(docs), 3),
        (near_dedup.drop_near_duplicates(docs), 2),
        (decontamination.drop_contaminated(docs, bench), 3),
    ):
        found = out.collect()
        assert len(found) == rows and all(r[n] == n for r in found for n in names)
    assert packing.pack_documents(docs).count() == 3 and token_files.read_token_files(token_files.write_token_files(docs)).count() == 3
    assert ngram_lm.score_documents(docs, ngram_lm.train(docs)).count() == 3 and media.load_media(spark, media.store_texts(docs)).count() == 3


def test_every_query_against_its_contract(spark):
    import hashlib
    import math
    from collections import Counter

    from samplemill.llm.queries import QUERIES

    data = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = {int(name[2:].split("_")[0]): query(spark, data).toPandas() for name, query in QUERIES.items()}
    left = lambda d, m: zlib.crc32(str(d).encode()) % m
    byte, word = library("byte_bpe_50k.json"), library("word_bpe_49k.json")

    sequences = found[1].sort_values(["sequence_id", "offset"])
    assert (sequences.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert (sequences["offset"] == sequences.groupby("sequence_id")["length"].cumsum() - sequences["length"]).all()
    for d, own in found[1].sort_values("start").groupby("doc_id"):
        ids = np.array([*byte.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        assert list(own["start"]) == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() == len(ids) == own["doc_tokens"].iloc[0]
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own.itertuples())
    assert set(found[1]["doc_id"]) == set(texts)

    start = 0
    for r in found[5].sort_values("doc_id").itertuples():
        ids = np.array([*word.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)

    for r in found[6].itertuples():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        media_bytes = media.encode_image(padded, len(raw))
        assert (r.media_bytes, r.media_sha256) == (len(media_bytes), hashlib.sha256(media_bytes).hexdigest())

    langs = {r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").collect() if r["lang"] is not None and left(r["doc_id"], 4) != 2}
    for r in found[7].itertuples():
        has_letter = any(map(str.isalpha, texts[r.doc_id] or ""))
        assert r.held_out == (left(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and (r.lang_pred in langs if has_letter else r.lang_pred == "und")

    lower = {k: k + 32 for k in range(65, 91)}
    seqs = {d: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for d, t in texts.items()}
    c = Counter(w for d, s in seqs.items() if left(d, 10) for w in s)
    n, v = sum(c.values()), len(c)
    for r in found[9].itertuples():
        s = seqs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (left(r.doc_id, 10) == 0, len(s), sum(w in c for w in s), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s)) and r.score < 0
    assert all(set(found[k]["doc_id"]) == set(texts) and len(found[k]) == len(texts) for k in (2, 3, 5, 6, 7, 9))

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert sorted(found[8]["page_id"]) == sorted([*pages, *pages])
    for r in found[8].itertuples():
        response = warc.response_record(pages[r.page_id]["url"], r.page_id, pages[r.page_id]["html"])
        assert r.refers_to == warc.parse_record(response)[0]["warc-record-id"] and r.target_uri == (pages[r.page_id]["url"] or "")
        assert r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode())

    turns = {}
    for r in spark.read.parquet(f"{data}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], set()).add((r["turn"], r["role"], r["text"]))
    assert set(found[4]["conv_id"]) == set(turns)
    for _, own in found[4].sort_values("turn_no").groupby("conv_id"):
        assert list(own["turn_no"]) == list(range(len(own))) and list(own["first_line"]) == [0, *own["n_lines"].cumsum()[:-1]]

    # each document that holds a whole benchmark item word by word is found with it
    plain = lambda t: " " + " ".join(x for x in (w.strip(".,;:!?()\"'").casefold() for w in (t or "").split()) if x) + " "
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    pairs = {(r.doc_id, r.item_id) for r in found[10].itertuples()}
    held = {(d, i) for d, t in texts.items() for i, x in items.items() if len(x.split()) >= 8 and x in plain(t)}
    assert held <= pairs and held


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, stays string, _key string"
    de, en = "der Hund und die Katze gehen heute nicht in den Wald ", "the dog and the cat do not go into the wood today "
    rows = [(1, de * 20, "de", "s", 1), (2, en * 20, "en", "s", 1), (3, None, "en", "s", None), (4, "", None, None, 0), (None, en + "with no id at all here", None, "s", 1), (None, de + "auch ohne Nummer hier", None, "s", 1), (2, en * 20, "en", "s", 1), (5, en * 3000, "en", "s", 1), (6, de * 20, "de", "s", 1)]
    bench = spark.createDataFrame([(1, "How many dogs and cats do not go into the wood today?"), (None, None)], "item_id long, text string")
    for name, some in (("full", rows), ("none", [])):
        docs = spark.createDataFrame([(*r, "x", "y") for r in some], schema)
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).toPandas()
        ids = sorted(out["doc_id"].fillna(-1).unique())
        assert ids == ([-1, 1, 2] if some else []), ids


def test_decontamination_of_sums_and_first_names(spark):
    sums = ["What is 12 + 7?", "Simplify 3/4 + 5/6 - 1/2", "Compute 14 % of 250"]
    story = "Janet sells 16 duck eggs at the farmers market daily for 2 dollars and bakes muffins with 4 of the rest."
    bench = spark.createDataFrame([*enumerate([*sums, story, "Yes.", "12 + 7", "So it is 7."], 1)], "item_id long, text string")
    docs = [
        (1, "Homework. What is 12 + 7? Easy."), (2, "Now: what is 45 + 9 ?"), (3, "Simplify 1/4 + 5/7 - 1/9 please"), (4, "Compute 14 % of 250 now"), (5, "Then what is 12 - 7 ?"),
        (6, f"Problem 3, {story}"), (7, story.replace("Janet", "Peter").replace("16", "20")), (8, f"Asked Bob. {story}"), (9, "Yes. So it is 7. 12 + 7 is a sum."), (10, "The farmers market sells eggs daily for 2 dollars."),
        (7, story.replace("Janet", "Peter").replace("16", "20")), (12, LONG + " " + story + " " + LONG),
    ]
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1): False, (2, 1): True, (3, 2): True, (4, 3): False, (6, 4): False, (7, 4): True, (8, 4): False, (12, 4): False}


def test_near_dedup_of_chains(spark):
    """Families whose members drift away from their first: each links with its neighbours only, or hardly."""
    import random

    rnd, texts = random.Random(11), {}
    for family in range(40):
        words = [f"f{family}w{k}" for k in range(rnd.randint(60, 140))]
        for member in range(50):
            texts[50 * family + member] = " ".join(words)
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = f"f{family}m{member}x{rnd.random()}"
    docs = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    want = {}
    for family in range(40):
        want |= {d: c for d, (_, c) in components({d: texts[d] for d in range(50 * family, 50 * family + 50)}).items()}
    wrong = sum(got[d] != want[d] for d in want)
    assert len(set(want.values())) > 60 and wrong == 0


def test_near_limits():
    """Sketches of a pivot and of what links with a core member pass; those of linked pairs too."""
    rng, samples, bits = np.random.default_rng(1), 130, 512
    for percent, limit in ((85, near_dedup.odd_limit(samples, bits, 85)), (55, near_dedup.star_limit(samples, bits, 85))):
        differing = rng.binomial(samples, 1 - percent / 100, 4000)
        apart = [int((np.bincount(rng.integers(0, bits, 2 * k), minlength=bits) % 2).sum()) for k in differing]
        assert max(apart) <= limit


def test_hot_pivots_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIVOT_MEMBERS", 4)
    base = [f"w{k}" for k in range(200)]
    texts = {d: " ".join([*base[: d % 190], f"own{d}", *base[d % 190 + 1 :]]) for d in range(60)}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in components(texts).items()}


def test_a_rest_of_a_bucket_gives_rows_by_members(spark, monkeypatch):
    """300 copies with few edits in two buckets: 89,700 pairs of near sketches, joined by a row a member and block."""
    rng, rows = np.random.default_rng(3), []
    for family in range(2):
        sketch = rng.integers(-(2**62), 2**62, 8)
        for m in range(300):
            own = sketch.copy()
            own[m % 8] ^= 1 << (m % 60)
            rows += [(bucket, 600, bytes([family, m // 256, m % 256]), own.tolist()) for bucket in (1, 2)]
    rest = spark.createDataFrame([*rows, (3, 2, b"a", [0] * 8), (3, 2, b"b", [1] * 8), (4, 2, b"c", [0] * 8), (4, 2, b"d", [-1] * 8)], "bucket long, n long, set_key binary, sketch array<long>")
    for size, most in ((1024, 1), (128, 25)):
        monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", size)
        got = [(bytes(r["u"]), bytes(r["v"])) for r in near_dedup.rest_links(rest, 20).collect()]
        assert len(got) <= most * 600 + 1 and (b"a", b"b") in got and not any({b"c", b"d"} & {*link} for link in got)
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for u, v in got:
            root[find(u)] = find(v)
        assert len({find(bytes(r[2])) for r in rows}) == 2


def test_near_dedup_in_blocks(spark, monkeypatch):
    """Loose families that pivots leave whole, compared in blocks of a few: all components as of all pairs."""
    import random

    monkeypatch.setattr(near_dedup, "PAIR_MEMBERS", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 8)
    monkeypatch.setattr(near_dedup, "PIVOT_ROUNDS", 1)
    rnd, texts = random.Random(13), {}
    for family in range(6):
        words = [f"f{family}w{k}" for k in range(90)]
        for member in range(30):
            texts[30 * family + member] = " ".join(words)
            words[rnd.randrange(90)] = f"f{family}m{member}"
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {d: c for d, (_, c) in components(texts).items()}


def test_windows_are_mixed_once(monkeypatch):
    """One pass of mixing for all windows of a text, whatever their length; other words or another order, another hash."""
    calls, mixed = [], decontamination.mix
    monkeypatch.setattr(decontamination, "mix", lambda x: calls.append(len(x)) or mixed(x))
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    for size in (3, 8, 20):
        calls.clear()
        hashes = lambda w: decontamination.window_hashes(*decontamination.template(" ".join(w))[:2], size, 1)[1]
        once = hashes(words)
        assert calls == [400 - size + 1] and len(np.unique(once)) == len(once) and (hashes(words[5:]) == once[5:]).all()
        swapped = [*words[:1], words[2], words[1], *words[3:]]
        assert hashes(swapped)[0] != once[0] and (hashes(swapped)[3:] == once[3:]).all()
        assert (hashes(["same"] * 30) == hashes(["same"] * 30)[0]).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_white_space_is_told_without_a_pattern(name, monkeypatch):
    """Texts of words between single blanks and line feeds need no pattern; with any white space the ids are the library's."""
    import re
    import types

    searched, ragged = [], tokens._RAGGED
    monkeypatch.setattr(tokens, "_RAGGED", types.SimpleNamespace(search=lambda x: searched.append(x) or ragged.search(x)))
    enc, t = tokens.ChunkEncoder(tokens.public_path(name)), library(name)
    plain = [f"Once again, the word{k % 7} of\nmany texts. Été {'long' * (1 + k % 20)}" for k in range(100)] + ["one", "one\ntwo"]
    odd = [c.join(["one", "two, three", "four"]) for c in [chr(k) for k in range(0x3001) if chr(k).isspace()] + ["  ", "\n\n", " \n", "\n "]]
    odd += [" ", "\n", "\none two", " one two", "one two ", "one\t\u3000two three"]
    ids = lambda x: np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    assert enc.encode_all(plain) == [*map(ids, plain)] and not searched
    assert enc.encode_all(odd) == [*map(ids, odd)] and not any(len(w) > tokens.MEMO_CHARS for w in enc.memo)
    assert [tokens._is_ragged(x) for x in plain + odd] == [re.search(r"\s\s|\A\s|\s\Z", x) is not None for x in plain + odd]


def test_near_dedup_takes_few_shuffles(spark):
    """Tasks of all its shuffles, which is what small tables over many partitions cost."""
    words = [f"w{k}" for k in range(60)]
    texts = {k: " ".join([*words[: 57 - k % 3], *[f"d{k // 8}x{j}" for j in range(30)], f"m{k}"]) for k in range(64)}
    docs, context, key = spark.createDataFrame([*texts.items()], "doc_id long, text string"), spark.sparkContext, "spark.sql.adaptive.coalescePartitions.enabled"
    tracker, partitions = context.statusTracker(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(key, "false")
    context.setJobGroup("near-shuffles", "")
    try:
        near_dedup.near_duplicates(docs).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset(key)
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = {k for job in tracker.getJobIdsForGroup("near-shuffles") for k in tracker.getJobInfo(job).stageIds}
    infos = [i for i in map(tracker.getStageInfo, stages) if i]
    assert sum(i.numCompletedTasks >= partitions for i in infos) <= 86


def test_letters_and_punctuation_are_encoded_once(monkeypatch):
    """Words that differ in case or in punctuation behind them don't go to the library one by one; ids stay its own."""
    enc = tokens.ChunkEncoder(tokens.public_path("word_bpe_49k.json"))
    sent, encode_parts, whole = [], enc._encode_parts, enc._whole
    monkeypatch.setattr(enc, "_encode_parts", lambda parts: sent.extend(parts) or encode_parts(parts))
    monkeypatch.setattr(enc, "_whole", lambda texts: sent.extend(texts) or whole(texts))
    texts = [f"{w}{tail}" for w in ("straße", "STRASSE", "Straße", "ÀÉÎ", "àéî", "Þorn", "x", "don't", "it's", "a_b", "été") for tail in ("", ".", ",***", "$$$", "!!", "'", "_", "'s", "…", "_-~`|{}[]")]
    texts += ["ABC.", "l" * 60 + ",,", "'s", "İx", "ΣΑΣ.", "ǅ!", "...", "éa!"]
    got = enc.encode(" ".join(texts))
    assert np.frombuffer(got, "<u4").tolist() == enc.tokenizer.encode(" ".join(texts), add_special_tokens=False).ids
    assert sent.count("straße") == 1 and not {"Straße", "Straße$$$", "straße$$$", "ÀÉÎ!!", "ABC."} & {*sent}
    assert not [w for w in enc.memo if len(w) > tokens.MEMO_CHARS]
    assert enc.encode("Straße,*** ABC") == whole(["Straße,*** ABC"])[0]
