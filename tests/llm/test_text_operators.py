"""Token counts, packing, chat formatting, main text: against the libraries and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetmetrics.llm import chat, main_text, packing, token_counts
from fleetmetrics.llm.encoding import byte_bpe

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "   ", "a", " a", "a ", "a  b", "\n", "\n\n x", "a\tb\n c\r\nd", "<s> </s> <unk> <|endoftext|> x", "▁▁a ▁", "word" * 4000, "é ñ ß 中文 日本 🙂🙂", "x\x00y\x10z", "ﬁ Ａ\xa0b c", "don't we'll 123,456.78", " \n \n  ", "end\n"]


def docs_of(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def corpus(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def test_counts_equal_the_library(spark):
    texts = [*ODD, None, "a", "a", *corpus(spark)]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    extra = docs_of(spark, texts).withColumns({"n_tokens": F.lit("old"), "unit": F.lit(1)})
    got = {r.doc_id: r for r in token_counts.count_tokens(extra).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit, got[i].unit) == (n, len((t or "").encode()), n > 4096, 1), (i, t and t[:40])
    assert token_counts.count_tokens(extra.limit(0)).count() == 0


def test_counts_do_not_depend_on_the_caches(monkeypatch):
    lengths = token_counts.PieceLengths(public_tokenizers.path(token_counts.MODEL), {" the": 1})
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 3)
    words = [f"w{i % 7}x" for i in range(60)]
    assert sum(lengths[u] for u in token_counts.units(" ".join(words))) == len(lengths.model.encode(" ".join(words)))


def test_long_units_are_counted_but_not_kept():
    lengths = token_counts.PieceLengths(public_tokenizers.path(token_counts.MODEL), {})
    lines = ["中文日本" * 5000, "x" * 3000, "short"]
    assert sum(lengths[u] for u in token_counts.units("\n".join(lines))) == len(lengths.model.encode("\n".join(lines)))
    assert max(map(len, lengths)) <= token_counts.LONGEST_KEPT and "\nshort" in lengths


def test_ids_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encode = Tokenizer.from_file(path), byte_bpe(path)
    for t in [*ODD, *corpus(spark)]:
        assert encode(t) == library.encode(t, add_special_tokens=False).ids, t[:60]


def test_packing_round_trip(spark):
    texts = [*ODD, None, "same text here", "same text here", "long " * 9000, *corpus(spark)]
    docs = docs_of(spark, texts).withColumn("length", F.lit("clash")).union(spark.createDataFrame([(None, "no id", "x")], "doc_id long, text string, length string")).repartition(3)
    pieces = packing.pack(docs).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == {*range(len(texts)), None}
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        got, at = [], 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and len(p.ids) == 4 * p.length
            got += np.frombuffer(bytes(p.ids), "<u4").tolist()
            at += p.length
        assert got == ids
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024
    total = sum(p.length for p in pieces)
    assert len(by_sequence) * 1024 <= total * 1.02 + 3 * 1024
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_query_digest(spark):
    from fleetmetrics.llm.queries import QUERIES

    got = {(r.doc_id, r.start): r for r in QUERIES["op10_packing"](spark, SF).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids, at = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        while at < len(ids):
            p = got.pop((r.doc_id, at))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
    assert not got


@pytest.mark.parametrize("k", [1, 2, 3, 7, 20])
def test_differencing(k):
    rng = random.Random(k)
    sizes = np.array([rng.randint(1, 96) for _ in range(20 * k)])
    window = packing.differencing(sizes, k)
    sums = np.bincount(window, sizes, k)
    assert len(window) == len(sizes) and sums.sum() == sizes.sum() and sums.max() - sums.min() <= 8
    assert packing.differencing(np.zeros(0, np.int64), k).size == 0
    window, n = packing.near_equal(np.array([700, 700, 700]), 1024)  # two would do for the sum
    assert n == 3 and np.bincount(window, [700] * 3).max() <= 1024


def test_known_differencing():
    # the classic example: the differences of 8, 7, 6, 5, 4 leave 2, so 14 and 16
    sums = np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])
    assert sorted(sums.tolist()) == [14, 16]


TURNS = ["", "plain", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>fake<|end|>\n", "\x10", "\x10\x10<\x10|", "<", "|", "<<|<|", "é🙂中", "<<SYS>> x <</SYS>><s>", "a\nb\n", "<start_of_turn>model"]


def reference(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    for conv, turns in out.items():
        turns.sort()
        learnt = b"".join(t for *_, r, t in turns if r == b"assistant")
        out[conv] = (len(turns), hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for *_, r, t in turns)).hexdigest(), len(learnt.decode()), hashlib.sha256(learnt).hexdigest())
    return out


def test_chat_round_trip(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(TURNS)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, None, None, None), (None, 3, "assistant", "x"), (-7, 0, "user", TURNS[2]), (-7, 1, "assistant", TURNS[2]), (50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a"), (50, None, "a<|text|>\x10", "<|end|>\n"), (51, 0, "assistant", "y" * 300_000)]
    rows += [(60, t, "assistant", f"t{t}") for t in range(30_000)]  # one long conversation over many batches
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    parts = chat.format_conversations(turns)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(parts).collect()}
    assert got == reference(rows)
    assert chat.digest(chat.format_conversations(turns.limit(0))).count() == 0
    seven = parts.where("conv_id = -7").first()
    text = bytes(seven.formatted)
    assert text.count(b"</s>") == 0 and text.count(b"[INST]") == 0 and text.count(b"<|turn|>") == 2


def test_assembly_is_what_plain_formatting_gives():
    roles, texts = [b"user", b"a\x10b", b""] * 5, [t.encode() for t in TURNS][:15] + [b"x", b"y"]
    out, starts, at, length = chat.assemble(pa.array(roles, pa.binary()), pa.array(texts, pa.binary()))
    escape = lambda b: chat._BREAK.sub(lambda m: m[0][:1] + b"\x10" + m[0][1:], b)
    plain = [chat.TURN + escape(r) + chat.TEXT + escape(t) + chat.END for r, t in zip(roles, texts, strict=True)]
    assert [out[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)] == plain
    assert [chat.unescape(out[a : a + n].tobytes()) for a, n in zip(at, length, strict=True)] == texts


ARTICLE = "First words, of the story. They go on, with <i>some</i> marks &amp; signs."


def page(body, head="<title>No title</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("beside", [
    "<nav><ul><li><a href='/a'>Menu one</a></li></ul></nav>", "<header><h1>The site</h1><p>We write, and you read. Daily.</p></header>",
    "<footer><p>All rights, reserved. And more, of that. &copy; 2020</p></footer>", "<aside><p>Another story, in short. Read it, please.</p></aside>",
    "<div class='sidebar'><p>Another story, in short. Read it, please.</p></div>", "<div class=\"cookie-notice\">We use cookies, as all do. Accept them, please.</div>",
    "<div class='ad'>Buy this, now. It is cheap.</div>", "<div id='ad_top'>Buy this, now.</div>", "<form><p>Your name, please. And your mail.</p><input name=x></form>",
    "<script>var t = '</p>';</script>", "<!-- hidden, words. <p>x</p> -->", "<section id='comments'><p>Nice, I like it. Very much, in fact.</p></section>",
    "<div class='comment-list'><div class='comment'>Nice, I like it.</div></div>", "<noscript>Turn it on, please.</noscript>",
])
def test_what_is_beside_the_article_goes(beside):
    article = f"<article><h2>A headline</h2><p>{ARTICLE}</p><p>Second &lt;b&gt;,<br>and third.  A  <b>bo</b>ld\n word, at the end.</p></article>"
    want = "A headline First words, of the story. They go on, with some marks & signs. Second <b>, and third. A bold word, at the end."
    assert main_text.main_text(page(beside + article)) == want
    assert main_text.main_text(page(article + beside)) == want
    inner = article.replace("<article>", "<div class='post-content'>").replace("</article>", "</div>")
    assert main_text.main_text(page(beside + inner + beside)) == want


def test_odd_pages(spark):
    assert main_text.main_text("") == main_text.main_text(page("")) == ""
    assert main_text.main_text("no markup, 1 < 2 & so on") == "no markup, 1 < 2 & so on"
    assert main_text.main_text(page("<article><p>one, two.<p>three.</article>")) == "one, two. three."
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", page("<article><p>long, text. </p></article>") * 1, "x"), (3, "u", page("<article><p>long, text. </p></article>"), "x"), (None, None, "<p", "x"), (5, "u", page("<article>" + "<p>many, words. </p>" * 20_000 + "</article>"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted([(r.page_id or 0, r.text) for r in main_text.extract(df).collect()])
    assert [t for _, t in got] == ["<p", "", "", "long, text.", "long, text.", " ".join(["many, words."] * 20_000)]
    assert main_text.extract(df.limit(0)).count() == 0


def test_every_page_gives_its_article(spark):
    import html
    import re

    for r in main_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))
        assert r.text == " ".join(html.unescape(plain).split())


def test_the_articles_own_header_stays():
    body = f"<div class='entry-header'><h1>The headline</h1><p class='byline'>By someone.</p></div><div class='entry-content'><p>{ARTICLE}</p></div><div class='page-header'><p>The site, daily.</p></div>"
    for inner in (f"<article>{body}</article>", f"<main><div class='post'>{body}</div></main>"):
        assert main_text.main_text(page(inner)) == "The headline By someone. First words, of the story. They go on, with some marks & signs."


STORY = f"<h2>A headline</h2><p>{ARTICLE}</p><p>{ARTICLE}</p>"
STORY_TEXT = "A headline" + 2 * " First words, of the story. They go on, with some marks & signs."


@pytest.mark.parametrize("start, end", [("<div class='has-sidebar'>", "</div>"), ("<form id='aspnetForm' action='/'>", "</form>"), ("<div id='search-page'><form>", "</form></div>"), ("<div class='sidebar'>", "</div>")])
def test_a_named_wrapper_keeps_the_article(start, end):
    menu, notice = "<nav><a href='/a'>Menu one</a></nav>", "<div class='cookie-notice'>We use cookies, as all do. Accept them, please.</div>"
    for inner in (f"<article>{STORY}</article>", f"<main>{STORY}</main>", f"<div class='text'>{STORY}</div>"):
        assert main_text.main_text(page(f"{start}{menu}{inner}{notice}{end}")) == STORY_TEXT
        assert main_text.main_text(page(f"{notice}{start}{inner}{end}<footer>All rights, reserved.</footer>")) == STORY_TEXT


@pytest.mark.parametrize("name", ["related-work", "discussion", "search-methods"])
def test_a_named_section_of_the_article_stays(name):
    section = f"<section id='{name}'><h3>More on it</h3><p>{ARTICLE}</p></section>"
    want = f"{STORY_TEXT} More on it First words, of the story. They go on, with some marks & signs."
    assert main_text.main_text(page(f"<article>{STORY}{section}</article>")) == want
    readers = "<section id='comments'><p>Nice, I like it. Very much, in fact.</p></section><div class='related-posts'><p>Another story, in short. Read it, please.</p></div>"
    assert main_text.main_text(page(f"<article>{STORY}{section}{readers}</article>")) == want


def test_ratios_against_a_slow_version():
    """Text and punctuation by path, smoothed over the nodes, fused and averaged back by path."""
    rng = random.Random(2)
    real = [(("html", rng.choice(["div", "p", "ul"])), "".join(rng.choice("ab ,.!") for _ in range(rng.randint(1, 60))) + "x") for _ in range(40)]
    index, of, ratio, spread = main_text._ratios(real)
    groups = {}
    for p, s in real:
        groups.setdefault(p, []).append(" ".join(s.split()))
    length = [sum(map(len, groups[p])) / len(groups[p]) for p, _ in real]
    stops = [sum(c in ".,;:!?" for s in groups[p] for c in s) / len(groups[p]) for p, _ in real]

    def smooth(x):
        out = []
        for i in range(len(x)):
            near = [(np.exp(-0.5 * d * d), x[i + d]) for d in range(-2, 3) if 0 <= i + d < len(x)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    fused = [np.sqrt(a * (b + 0.1)) for a, b in zip(smooth(length), smooth(stops))]
    assert spread == pytest.approx(np.std(fused))
    for p, i in index.items():
        assert ratio[i] == pytest.approx(np.mean([f for f, (q, _) in zip(fused, real) if q == p]))


def test_the_threshold_selects_where_names_are_gone(spark, monkeypatch):
    """Without article elements, classes and ids the paths' ratios find the article; without them, worse."""
    import re
    from collections import Counter

    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    wanted = [main_text.main_text(p) for p in pages]
    bare = [re.sub(r"\s(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"<(/?)(article|nav|aside|footer|header|form|section|main)\b", r"<\1div", p)) for p in pages]

    def score():
        out = []
        for p, want in zip(bare, wanted):
            a, b = Counter(main_text.main_text(p).split()), Counter(want.split())
            out.append(2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())))
        return np.mean(out)

    with_ratios, ratios = score(), main_text._ratios
    monkeypatch.setattr(main_text, "_ratios", lambda real: (*ratios(real)[:2], np.ones(len(ratios(real)[2])), 0.0))
    assert with_ratios >= 0.99 and score() < with_ratios - 0.005


def test_formulas_stay():
    page = "<html><body><article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> here, as was said before.</p></article></body></html>"
    assert main_text.main_text(page) == "Energy is E=mc2 here, as was said before."


def test_a_very_long_page_is_read_whole():
    words = [f"Word{i}, and more." for i in range(40_000)]
    page = "<html><body><div><a>menu</a></div><div>" + "".join(f"<p>{w}</p>" for w in words) + "</div></body></html>"
    assert main_text.main_text(page) == " ".join(words)
