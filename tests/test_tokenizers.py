"""Byte-pair tokenizers against the tokenizers library, and chat templates as Columns."""

import random

import pytest
from pyspark.sql import functions as F

from samplemill.functions.templates import ChatTemplate, TemplateError
from samplemill.operators import subwords, tokens
from samplemill.plans.stage import Context

public = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.fixture(params=FILES)
def pair(request):
    from tokenizers import Tokenizer

    path = public.path(request.param)
    return subwords.BytePairTokenizer(path), Tokenizer.from_file(path)


def test_ids_are_those_of_the_library(spark, pair):
    own, library = pair
    rnd = random.Random(3)
    parts = ["the", "The,", "Éa.", "x9", "don't", "ß", "İx", "ΑΣ", "1.5", "...", "(a)", "日本", "é,", "é", "à", "​", "<|endoftext|>", "①", "½", "we'LL", "a\x1cb", "😀"]
    gaps = [" ", " ", "\n", "  ", "\n\n", "\t", "\r\n", " \n", "\x1c", "\x85", "\xa0", "", "　"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(gaps) for _ in range(rnd.randint(0, 9))) for _ in range(1500)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.encode(t) for t in texts] == want and all(own.encode(t, 4) == w[:4] for t, w in zip(texts, want, strict=True))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = docs.select("text", own.ids(F.col("text")).alias("ids")).collect()
    assert len(got) == 200 and all(r["ids"] == library.encode(r["text"], add_special_tokens=False).ids for r in got)


def test_texts_come_back():
    own = subwords.BytePairTokenizer(public.path(FILES[0]))
    for text in ("Hello, wörld!\n\n 日本 x9", "", " a  b ", "😀"):
        assert own.decode(own.encode(text)) == text
    word = subwords.BytePairTokenizer(public.path(FILES[1]))
    assert word.decode(word.encode("Hello, World")) == "hello , world" and word.decode([49406, *word.encode("a b"), 49407]) == "a b"


def test_tokenize_with_a_file(spark):
    own = subwords.BytePairTokenizer(public.path(FILES[1]), pad_id=49407, begin_id=49406, end_id=49407)
    rows = [(0, 0, "one two three four five six seven"), (0, 1, "one"), (0, 2, ""), (0, 3, None)]
    df = spark.createDataFrame(rows, "variation int, idx long, text string")
    out = tokens.Tokenize("text", "ids", "mask", own, 6).apply(df, Context(spark))
    got = [(r["ids"], r["mask"]) for r in out.orderBy("idx").collect()]
    plain = own.encode("one two three four five six seven")
    assert got[0] == ([*plain[:5], 49407], [1] * 6) and plain[0] == 49406
    assert got[1] == ([49406, own.encode("one")[1], 49407, 49407, 49407, 49407], [1, 1, 1, 0, 0, 0]) and got[2][0] == [49406] + [49407] * 5
    back = tokens.DecodeTokens("ids", "back", tokenizer=own).apply(out.filter("idx < 2"), Context(spark)).orderBy("idx").collect()
    assert [r["back"] for r in back] == ["one two three four", "one"]


def test_files_that_are_not_understood(tmp_path):
    (tmp_path / "x.json").write_text('{"model": {"type": "WordPiece"}}')
    with pytest.raises(ValueError, match="byte-pair"):
        subwords.BytePairTokenizer(str(tmp_path / "x.json")).encode("a")
    with pytest.raises(FileNotFoundError):
        subwords.BytePairTokenizer(str(tmp_path / "none.json")).encode("a")


MESSAGES = "array<struct<role:string,content:string>>"


def rendered(spark, template, *conversations, **names):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(conversations)], f"k int, m {MESSAGES}")
    return [r["t"] for r in df.select("k", ChatTemplate(template, **names)(F.col("m")).alias("t")).orderBy("k").collect()]


TALK = [("system", " be kind "), ("user", "Hi"), ("assistant", "Hello")]


@pytest.mark.parametrize(
    ("template", "text"),
    [
        ("plain", "plain"),
        ("{# note #}{% for m in messages %}<|{{ m.role }}|>{{ m['content'] | trim }}\n{% endfor %}", "<|system|>be kind\n<|user|>Hi\n<|assistant|>Hello\n"),
        ("{% for m in messages %}\n{% if m.role == 'system' %}S:{{ m.content.strip() }};{% elif m.role == \"user\" and not loop.first %}U{{ loop.index }}{% else %}({{ loop.index0 }}){% endif %}\n{% endfor %}", "S:be kind;U2(2)"),
        ("{{ bos }}{%- for m in messages -%}  {{ m.role ~ ':' ~ m.content | upper }} {%- if not loop.last %}, {% endif -%}\n{%- endfor -%}\n", "<s>system: BE KIND , user:HI, assistant:HELLO"),
        ("{% set first = messages[0] %}{{ first.role | upper }}{{ messages | length }}{% if add %}>{% endif %}{{ nothing }}{{ other | default('d') }}", "SYSTEM3>d"),
        ("{{ 'a' if messages[0].role != 'system' else 'b\\n' }}{{ 1 + 2 }}{{ 'x' + 'y' }}{{ 7 % 4 }}", "b\n3xy3"),
        ("{% if nothing is defined %}no{% else %}yes{% endif %}{% if 'in' in 'kind' and messages[1].content in 'Hi there' %}!{% endif %}{% if true or false %}t{% endif %}", "yes!t"),
        ("{% for m in messages %}{% if loop.index % 2 == 0 %}{{ m.role }}{% endif %}{% endfor %}", "user"),
        ("{% for m in messages %}{% for n in messages %}{{ loop.index }}{% endfor %}{% endfor %}", "123123123"),
    ],
)
def test_templates(spark, template, text):
    assert rendered(spark, template, TALK, bos="<s>", add=True) == [text]


def test_templates_of_odd_rows_and_faults(spark):
    template = "{% for m in messages %}{{ m.role }}={{ m.content }};{% endfor %}end"
    assert rendered(spark, template, TALK[1:], [], None, [("user", None), (None, "x")]) == ["user=Hi;assistant=Hello;end", "end", None, "user=;=x;end"]
    checked = "{% if messages[0].role != 'user' %}{{ raise_exception('starts with ' + messages[0].role) }}{% endif %}ok"
    assert rendered(spark, checked, TALK[1:]) == ["ok"]
    with pytest.raises(Exception, match="starts with system"):
        rendered(spark, checked, TALK)
    for broken in ("{% for m in messages %}", "{% if x %}a", "{% macro f() %}{% endmacro %}", "{% endfor %}"):
        with pytest.raises(TemplateError):
            ChatTemplate(broken)
    for broken in ("{{ a b }}", "{{ 'x' | tojson }}", "{{ ( }}", "{{ ? }}"):
        with pytest.raises(TemplateError):
            ChatTemplate(broken)(F.lit(None))


def test_template_before_tokens(spark):
    df = spark.createDataFrame([(0, 0, TALK)], f"variation int, idx long, m {MESSAGES}")
    stage = tokens.Tokenize("m", "ids", "mask", tokens.HashVocabulary(1000), 8, chat_template=ChatTemplate("{% for m in messages %}{{ m.role }} {{ m.content }} {% endfor %}"))
    row = stage.apply(df, Context(spark)).first()
    assert row["mask"] == [1] * 7 + [0] and len(set(row["ids"][:7])) == 7
