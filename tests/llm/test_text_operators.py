"""HTML, sharding, language, PII, chat and decontamination against plain versions."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import chat_format, decontam, html_extract, langid, pii, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- html ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>", ""), ("<script>x", ""), ("<!-- x", ""),
        ("<body><nav><a href=x>m</a></nav><article><h1>T &amp; u</h1><p>One,\n two<br>three<p>four</article><footer>f</footer>", "T & u\n\nOne, two three\n\nfour"),
        ("<div class='sidebar'><p>a, b, c, long words here</p></div><div id=content><p>Body, of text</p><ul><li>x<li>y</ul></div><div class=comments><p>so, nice, yes</p></div>", "Body, of text\n\nx\n\ny"),
        ("<article><header><h1>Title</h1></header><div class='ad'>Buy</div><p>text&lt;p&gt;</p></article>", "Title\n\ntext<p>"),
        ("<form><input><article><p>inside, a form</p></article></form>", "inside, a form"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
        ("a < b & c", "a < b & c"),
    ],
)
def test_html(page, text):
    assert html_extract.extract_text(page) == text


LONG = "This paragraph, like the others, has commas, is long, and tells something, so that it counts, as an article does."
PLAIN = "words without any pause that go on for a while and then for a while more until they end"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # link density: more text and commas, but in links
        (f"<body><div>{''.join(f'<p><a href=x>{LONG}, {i}, and more, and more</a></p>' for i in range(6))}</div><div><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG}\n\n{LONG}"),
        # the container: boxes without telling names beside the content
        (f"<body><div><p>Weather</p></div><div><div><p>{LONG}</p><p>{LONG}</p><p>Short</p><p>{LONG}</p></div></div><div><p>Buy now</p></div></body>", f"{LONG}\n\n{LONG}\n\nShort\n\n{LONG}"),
        # commas: equal lengths
        (f"<body><div><p>{PLAIN}</p></div><div><p>{'a, b, c, d, e, f, ' * 5}</p></div></body>", ("a, b, c, d, e, f, " * 5).strip()),
        # length: equal commas
        (f"<body><div><div><p>a</p></div></div><div><p>{PLAIN * 4}</p><p>{PLAIN * 4}</p></div></body>", f"{PLAIN * 4}\n\n{PLAIN * 4}"),
        # siblings of the best container: another part, a plain paragraph, the heading; not a box with little
        (f"<body><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div><p>A word in between.</p><div><p>{LONG}</p></div><div>Share</div></body>", f"Title\n\n{LONG}\n\n{LONG}\n\nA word in between.\n\n{LONG}"),
        # parts of an article are one container, however small
        (f"<main><article><section><p>{LONG * 3}</p></section><section><p>x</p></section></article><div><p>Also read</p></div></main>", f"{LONG * 3}\n\nx"),
        # a longer list of teasers in links isn't the article
        (f"<body>{''.join(f'<article><a href=x>{LONG}</a></article>' for _ in range(4))}<article><p>{LONG}</p></article></body>", LONG),
        # boilerplate inside an article
        ("<article><p>yes, this</p><div class='post-comments'><p>so, nice, yes</p></div><div class='page-footer'>f</div><ul id=main-menu><li>m</ul><footer>g</footer><aside>h</aside></article>", "yes, this"),
        ("<article><p>yes, this</p><section><h3>3 comments</h3><p>no, that</p></section><ul><li><a href=x>one</a><li><a href=y>two</a></ul></article>", "yes, this"),
        ("<body class='has-sidebar'><div class='content-sidebar-wrap'><div class='entry-header'><h1>T</h1></div><p>yes, this, and more, of it</p></div><div class='sidebar'>s</div></body>", "T\n\nyes, this, and more, of it"),
        ("<body><aside><article><p>no, teaser</p></article></aside><article><p>yes, the article, which is longer</p></article></body>", "yes, the article, which is longer"),
        ("<div class='comments'><p>all, that, there is</p></div>", "all, that, there is"),
        ("<article><p>&#233;&eacute; &amp;lt; a<b>b</b>c\n\t d&nbsp;e</p>tail</article>", "éé &lt; abc d e\n\ntail"),
    ],
)
def test_html_scores(page, text):
    assert html_extract.extract_text(page) == text


STORY = f"<p>{LONG}</p><p>{LONG}</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # articles that are comments or teasers, beside the story and in main
        (f"<article>{STORY}</article><div><article class='comment'>I agree, all of it</article></div>", f"{LONG}\n\n{LONG}"),
        (f"<main><article>{STORY}</article><article class='comment'>I agree, all of it</article><article class='teaser'>Read this, too</article></main>", f"{LONG}\n\n{LONG}"),
        (f"<main>{STORY}<article class='comment'><p>{LONG}</p></article></main>", f"{LONG}\n\n{LONG}"),
        # words alone and in compounds
        *[(f"<article>{STORY}<div class='{c}'><p>{LONG}</p></div></article>", f"{LONG}\n\n{LONG}") for c in ("user-reviews", "feedback", "alert alert-info", "cookiebar", "postcomments", "adbox", "js-adslot2 ad", "commentlist", "topads", "newsletter2", "related-posts", "discussion", "sponsoredbox")],
        # words that may be the text's own
        (f"<article>{STORY}<p class='discussion'>{LONG}</p></article>", f"{LONG}\n\n{LONG}\n\n{LONG}"),
        (f"<article>{STORY}<section id='related-work'><h2>Related work</h2><p>{LONG}</p></section></article>", f"{LONG}\n\n{LONG}\n\nRelated work\n\n{LONG}"),
        (f"<article class='review'>{STORY}</article>", f"{LONG}\n\n{LONG}"),
        (f"<article>{STORY}<section class='related'><p><a href=x>{LONG}</a></p></section><p class='related'>see also</p></article>", f"{LONG}\n\n{LONG}"),
        # other words that only look alike
        (f"<article>{STORY}<p class='address lead-in headline'>{LONG}</p><p class='loads readme uploads shadow'>{LONG}</p></article>", f"{LONG}\n\n{LONG}\n\n{LONG}\n\n{LONG}"),
    ],
)
def test_html_class_words(page, text):
    assert html_extract.extract_text(page) == text


def test_html_without_article_is_decided_by_scores():
    """Pages of plain boxes: the story's box is found among lists of links, short boxes and named ones, at any depth and place."""
    rng = random.Random(21)
    word = lambda: rng.choice("lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor".split())
    for _ in range(60):
        story = [" ".join(word() for _ in range(rng.randint(25, 60))) + "." for _ in range(rng.randint(3, 8))]
        box = "".join(f"<p>{p}</p>" for p in story)
        for _ in range(rng.randrange(3)):
            box = f"<div>{box}</div>"
        links = lambda: "<div>" + "".join(f"<p><a href=x>{' '.join(word() for _ in range(rng.randint(3, 20)))}</a></p>" for _ in range(rng.randint(1, 12))) + "</div>"
        short = lambda: f"<div><span>{word()}</span></div>"
        named = lambda: f"<div class='{rng.choice(['comments', 'cookiebar', 'ad-box', 'sidebar left', 'user-reviews'])}'>" + "".join(f"<p>{' '.join(word() for _ in range(60))}</p>" for _ in range(9)) + "</div>"
        others = [rng.choice([links, short, named])() for _ in range(rng.randint(1, 6))]
        at = rng.randint(0, len(others))
        page = "<html><body>" + "".join(others[:at]) + f"<div>{box}</div>" + "".join(others[at:]) + "</body></html>"
        assert html_extract.extract_text(page) == "\n\n".join(story), page


BROKEN = {"open": "<a ", "quote": '<a b="x ', "inline": "<b>", "items": "<li>x</li>", "less": "<", "raw": "<svg>", "quoted ends": "<a x=\">\" ", "cells": "<td>x", "comments": "<!--", "articles": "<article>", "ends": "</div>", "ps": "<p><b>"}


@pytest.mark.parametrize("name", BROKEN)
def test_html_is_linear_on_broken_markup(name):
    began = time.perf_counter()
    html_extract.extract_text("<b><table>" + "<div>" * 40_000 + BROKEN[name] * 40_000 + "</b>" * 40_000 + "x")
    assert time.perf_counter() - began < 4  # 200,000 tags; the former shapes took from 12 s up with a third of them


def test_html_keeps_ids_and_other_columns_do_no_harm(spark):
    df = spark.createDataFrame([(1, "u", "<p>a, b</p>", "t"), (1, "u", "<p>a, b</p>", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_extract.extract(df).collect()), key=str) == [(1, "u", "a, b"), (1, "u", "a, b"), (None, None, "")]
    assert html_extract.extract(df.limit(0)).collect() == []


# --- sharding ------------------------------------------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(1)
    texts = [rng.choice(["", None, "a", "é" * rng.randrange(40), "x" * rng.randrange(300)]) for _ in range(500)] + ["hot" * 50] * 300
    rows = [(rng.choice([i, i, 7, None]), t) for i, t in enumerate(texts)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    shards, where = defaultdict(list), defaultdict(set)
    for r in got:
        shards[r["shard"]].append(r)
        where[r["size"], r["text_crc32"]].add(r["shard"])
    assert set(shards) <= set(range(8)) and all(len(s) == 1 for s in where.values())
    for rows_ in shards.values():
        assert sorted(r["slot"] for r in rows_) == list(range(len(rows_)))
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= max(151 * 300, sum(sizes.values()) / 8 + 151 * 300)
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_plan_is_minimax(monkeypatch):
    rng = random.Random(2)
    for _ in range(300):
        keys = sorted({rng.randrange(-1 << rng.choice([3, 30, 63]), 1 << rng.choice([3, 30, 63])) for _ in range(rng.choice([1, 5, 60]))})
        groups = [(k, rng.choice([1, 50, rng.randrange(1, 2000)])) for k in keys]

        def cells(_, parents, groups=groups):
            bits = min(64, sharding.STEP + (parents[0].bits if parents else 0))
            found = defaultdict(list)
            for k, s in groups:
                if not parents or (k >> (64 - parents[0].bits)) in {c.low >> (64 - c.bits) for c in parents}:
                    found[k >> (64 - bits)].append((k, s))
            return [sharding.Cell(p << (64 - bits), bits, sum(s for _, s in v), len(v) == 1) for p, v in sorted(found.items())]

        monkeypatch.setattr(sharding, "_cells", cells)
        shards = rng.choice([1, 2, 8])
        capacity, first = sharding.plan(None, shards)

        def needs(c, groups=groups):
            used, now = 1, 0
            for _, s in groups:
                used, now = (used + 1, s) if now + s > c else (used, now + s)
            return used

        biggest = max(s for _, s in groups)
        assert needs(capacity) <= shards and capacity >= biggest and (capacity == biggest or needs(capacity - 1) > shards)
        sums = Counter()
        for k, s in groups:
            sums[sum(k >= c for c in first if c is not None)] += s
        assert max(sums.values()) <= capacity


# --- language ------------------------------------------------------------------------------------------------------


def test_viterbi_is_the_best_path():
    rng = random.Random(3)
    for _ in range(500):
        n, k, penalty = rng.randrange(1, 6), rng.randrange(1, 4), rng.choice([0, 0.5, 1, 3.0])
        s = np.array([[rng.choice([0, 1, 2, -1, 0.5]) for _ in range(k)] for _ in range(n)])
        value = lambda p, s=s, n=n, penalty=penalty: sum(s[i, p[i]] for i in range(n)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert value(list(langid.viterbi(s, penalty))) == pytest.approx(max(map(value, product(range(k), repeat=n))))


WORDS = {"en": "the of and with that this have from", "de": "der die und nicht mit sich auf eine", "ru": "это как что для они было после"}


def text_of(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_languages_and_spans(spark):
    rng = random.Random(4)
    rows = [(i, text_of(lang, 30, rng), lang, "s", 1) for i, lang in enumerate(["en", "de", "ru"] * 30)]
    mixed = text_of("en", 40, rng) + ". " + text_of("de", 60, rng)
    extra = [(900, mixed, None, "s", 1), (901, None, "en", "s", 1), (902, "12 !?", "de", "s", 1), (903, "", None, "s", 1), (904, "что", None, "s", 1), (904, "что", None, "s", 1)]
    docs = spark.createDataFrame(rows + extra, DOCS)
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _, _ in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, 904)] == ["de", "und", "und", "und", "ru"]
    assert [s["lang"] for s in got[900]["spans"]] == ["en", "de"] and got[900]["spans"][1]["end"] == len(mixed) and 0.5 < got[900]["score"] < 1
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


# --- personal data -------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_pii(text):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for i, c in enumerate(d[::-1]) for x in [int(c) * (1 + i % 2)]) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if ok(k, m[0])]


def test_pii_is_that_of_the_patterns():
    automaton, rng = pii.build_automaton(), random.Random(5)
    for _ in range(6000):
        s = "".join(rng.choice(rng.choice(["0123456789", "a.@-+ ()", "19.", "1 -", "@a.b", "+1 (2)", "AZ_%é", "4"])) for _ in range(rng.randrange(60)))
        assert [x for x in pii.find_spans(s, automaton) if x[0] in pii.BASE_KINDS] == plain_pii(s), s


def test_pii_added_kinds_and_redaction(spark):
    text = "IBAN: DE89 3704 0044 0532 0130 00 AND account no. 123456789 ssn 123-45-6789 https://a.b/c, x@y.zz"
    automaton = pii.build_automaton()
    spans = pii.find_spans(text, automaton)
    assert [(k, text[s:e]) for k, s, e in spans] == [("email", "x@y.zz"), ("account", "123456789"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("url", "https://a.b/c")]
    assert pii.redact_text(text, spans) == "IBAN: <IBAN> AND account no. <ACCOUNT> ssn <SSN> <URL>, <EMAIL>"
    secret = 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and {"api_key": "abc-123_x/9="}, PASSWORD: hunter22. Tokens = 5, token: words, secretary = 12345678'
    assert [secret[s:e] for k, s, e in pii.find_spans(secret, automaton) if k == "secret"] == ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "abc-123_x/9=", "hunter22"]
    df = spark.createDataFrame([(1, text, "q"), (2, None, None), (3, "", "é"), (1, text, "q")], "doc_id long, text string, spans string")
    got = pii.digest(pii.detect(df)).collect()
    assert sorted(r["n_email"] for r in got) == [0, 0, 1, 1] and {r["base_sha256"] for r in got if r["doc_id"] != 1} == {hashlib.sha256(b"").hexdigest()}
    assert pii.redact(df).columns == df.columns and pii.redact(df.limit(0)).collect() == []


# --- chat ----------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng, parts, rows = random.Random(6), ["\\", "###", "#", "</turn>", "<", "/turn>", "\n", "a", ": ", "h", "日", "\\h", "### user: ", "</turn>\n"], []
    for c in range(150):
        rows += [(c, t, rng.choice(["user", "assistant", "sys:tem", "x\\", " ", "###", None]), None if rng.random() < 0.05 else "".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for t in range(rng.randrange(1, 6))]
    rows += [(None, 0, "user", "q"), (None, 0, "user", "q")]
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_turns(chat_format.turns_of_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_layouts(spark):
    records = [
        ({"prompt": "a", "response": "b"}, [("user", "a"), ("assistant", "b")]), ({"completion": "c", "prompt": "p"}, [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]), ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, [("user", "q"), ("assistant", None)]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "z"}]}, [("user", "q"), ("assistant", "z")]),
        ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(records)], "conv_id long, record string")
    got = defaultdict(list)
    for r in chat_format.turns_of_records(df).orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert all(got[i] == turns for i, (_, turns) in enumerate(records))
    typed = spark.createDataFrame([(5, "i", "o")], "key long, instruction string, output string")
    assert [r["text"] for r in chat_format.turns_of_table(typed).orderBy("turn").collect()] == ["i", "o"]
    assert chat_format.rejected_records(df).collect() == []


def test_chat_mappings_are_selected_by_fingerprint():
    layouts = {n: paths for n, (paths, _) in chat_format.LAYOUTS.items()}
    assert len(chat_format.registry(layouts)) == len({mark for _, mark in chat_format.registry(layouts).values()}) == len(layouts)
    for name, paths in layouts.items():
        assert chat_format.layout_of({*paths, "other", "messages[].name"}, layouts) == name
    assert chat_format.layout_of({"prompt", "response", "completion"}, layouts) == "prompt_response"
    assert chat_format.layout_of({"prompt"}, layouts) is None and chat_format.layout_of(set(), layouts) is None


def test_chat_reasons_say_what_is_wrong(spark):
    bad = {'{"prompt": "a", "prompt": "b"}': "a key comes twice", '[1, 2]': "not an object", '"text"': "not an object", '{"x": 1}': "no known field", '{"prompt": "a"}': "no mapping for the fields prompt", "{": "not JSON", None: "null"}
    got = chat_format.rejected_records(spark.createDataFrame([(i, r) for i, r in enumerate(bad)], "conv_id long, record string")).collect()
    assert {r["record"]: r["reason"] for r in got} == bad


def test_chat_very_long_texts(spark):
    text = "### a</turn>\\" * 300_000
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text), (2, 0, "assistant", "x" * 5_000_000)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_turns(turns)).collect()}
    assert got[1]["loss_chars"] == len(text) and got[1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[2]["loss_chars"] == 5_000_000


def test_chat_odd_records_stop_nothing(spark):
    turn = {"role": "user", "content": "q"}
    good = [
        ({"messages": [turn], "id": 7, "meta": {"messages": 1}}, [("user", "q")]), ({"messages": [{**turn, "name": "bob"}, {"role": "gpt"}, {"content": "x"}]}, [("user", "q"), ("assistant", None), (None, "x")]),
        ({"messages": [{"role": "user", "content": [{"type": "text"}]}, {"role": "user", "content": 5}]}, [("user", '[{"type":"text"}]'), ("user", "5")]),
        ({"prompt": None, "response": "r", "extra": []}, [("user", None), ("assistant", "r")]), ({"messages": [turn], "prompt": "p", "response": "r"}, [("user", "q")]),
        ({"prompt": "é" * 300_000, "response": "###" * 100_000}, [("user", "é" * 300_000), ("assistant", "###" * 100_000)]),
    ]
    bad = ['{"messages": []}', '{"messages": null}', '{"messages": "x"}', '{"messages": [1, 2]}', "{", "", None, "[]", "3", '{"what": 1}', '{"prompt": "p"}']
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(good)] + [(100 + i, b) for i, b in enumerate(bad)] + [(None, bad[0])], "conv_id long, record string")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("v", "paths", "print", "turn", "role")])
    got = defaultdict(list)
    for r in chat_format.turns_of_records(df).orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got == {i: turns for i, (_, turns) in enumerate(good)}
    out = chat_format.rejected_records(df).collect()
    assert sorted((r["conv_id"] or 0, r["record"]) for r in out) == sorted([(100 + i, b) for i, b in enumerate(bad)] + [(0, bad[0])], key=lambda x: x[0])
    assert {r["reason"] for r in out if r["conv_id"] in (104, 105)} == {"not JSON"} and [r["reason"] for r in out if r["conv_id"] == 106] == ["null"]
    assert chat_format.turns_of_records(df.limit(0)).collect() == [] and chat_format.rejected_records(df.limit(0)).collect() == []
    formatted = chat_format.digest(chat_format.format_turns(chat_format.turns_of_records(df))).collect()
    assert {r["conv_id"]: r["formatted_chars"] for r in formatted}[5] == 300_000 + 200_000 + len("### user: </turn>\n### assistant: </turn>\n")


def test_chat_tables_with_other_columns(spark):
    rows = [(1, 0, "user", "a", 9, "x", "y", None, 3), (1, 1, "assistant", "b", 9, "x", "y", None, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id long, content string, piece string, place string, before long")
    assert [tuple(r) for r in chat_format.turns_of_table(df).orderBy("turn").collect()] == [r[:4] for r in rows]
    assert chat_format.format_turns(chat_format.turns_of_table(df)).first()["formatted"] == "### user: a</turn>\n### assistant: b</turn>\n"
    other = spark.createDataFrame([(4, 0, "user", "a", "x")], "conversation_id long, index long, role string, content string, text string")
    assert tuple(chat_format.turns_of_table(other).first()) == (4, 0, "user", "a")
    record = spark.createDataFrame([("k", [("user", "q", "n")], 2)], "key string, messages array<struct<role:string,content:string,name:string>>, v int")
    assert tuple(chat_format.turns_of_table(record).first()) == ("k", 0, "user", "q")
    assert chat_format.turns_of_table(record, "v").first()["conv_id"] == 2
    with pytest.raises(ValueError, match="no mapping"):
        chat_format.turns_of_table(spark.range(1))


# --- decontamination -----------------------------------------------------------------------------------------------


def plain_hits(text, items, window):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words, hit, found = pattern.findall(low(text)), set(), set()
    for name, t in items:
        own = pattern.findall(low(t))
        m = min(window, len(own))
        for q in range(len(own) - m + 1 if own else 0):
            for p in range(len(words) - m + 1):
                if words[p : p + m] == own[q : q + m]:
                    hit |= set(range(p, p + m))
                    found.add(name)
    return len(words), len(hit), sorted(found)


def test_decontamination(spark):
    rng = random.Random(7)
    for blocks in (8_000_000, 60):
        vocabulary = [rng.choice(["a", "b", "É", "日本", "x1"]) + str(rng.randrange(9)) for _ in range(8)]
        make = lambda n, v=vocabulary: rng.choice([" ", "\n", "-"]).join(rng.choice(v) for _ in range(n))
        items = [(i, make(rng.choice([0, 1, 3, 9, 10, 11, 14, 30]))) for i in range(12)] + [(50, None)]
        docs = [(i, make(rng.randrange(60))) for i in range(60)] + [(70, None), (71, ""), (72, "x " + items[-2][1].upper() + " y")]
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {r["doc_id"]: r for r in decontam.digest(decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=blocks)).collect()}
        for i, t in docs:
            n, hit, names = plain_hits(t, items, 10)
            names = sorted(map(str, names))
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"], got[i]["contaminated"]) == (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
    none = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0))
    assert {len(r["spans"]) for r in none.collect()} == {0}


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the word", "en", "id", "spans", 1)], "doc_id long, text string, lang string, id string, spans string, n_words long").withColumn("score", F.lit(1))
    assert decontam.contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 1
    assert langid.identify(docs, langid.fit(docs)).count() == 1 and pii.detect(docs).count() == 1
    more = docs.select("*", *[F.lit("x").alias(c) for c in ("size", "shard", "law", "slot", "text_crc32", "key", "h", "page_id", "url", "html", "row", "m", "a", "b")])
    assert sharding.assign(more).first()["size"] == 9
    assert decontam.contamination(more, more.select("text", F.col("doc_id").alias("item_id"), "id", "m"), block_bytes=0).first()["items"] == ["1"]
    assert html_extract.extract(more.withColumn("html", F.lit("<p>a</p>"))).first()["text"] == "a"
    assert {r["url"] for r in html_extract.extract(more).collect()} == {"x"}


def test_very_long_texts(spark):
    words = " ".join(["the of and with that this have from"] * 40_000)
    spans = "write to a@b.cd or +1 234 567 8901 " * 20_000
    docs = spark.createDataFrame([(1, words, "en"), (2, "der die und nicht mit sich auf eine " * 20, "de"), (3, spans, "en"), (4, "a " * 200_000, "en"), (5, "x" * 2_000_000, "en")], "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id <= 2"))
    found = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert found[1]["lang_pred"] == "en" and found[2]["lang_pred"] == "de" and found[1]["spans"][-1]["end"] == len(words)
    counts = {r["doc_id"]: (r["n_email"], r["n_phone"]) for r in pii.digest(pii.detect(docs)).collect()}
    assert counts[3] == (20_000, 20_000) and counts[1] == counts[4] == counts[5] == (0, 0)
    assert sum(r["size"] for r in sharding.assign(docs).collect()) == sum(len(t) + 1 for t in (words, "der die und nicht mit sich auf eine " * 20, spans, "a " * 200_000, "x" * 2_000_000))


def test_repeated_words_are_marked_in_linear_time(spark):
    """A word that fills a document and an item meets itself at every place of both."""
    docs = spark.createDataFrame([(1, "a " * 100_000 + "b"), (2, "b " + "a " * 9), (3, "a " * 10)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a " * 2_000), (8, "a " * 30), (9, "b")], "item_id long, text string")
    for block in (8_000_000, 0):
        began = time.perf_counter()
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.digest(decontam.contamination(docs, bench, block_bytes=block)).collect()}
        assert got == {1: (100_001, 100_001, 3), 2: (10, 1, 1), 3: (10, 10, 2)} and time.perf_counter() - began < 60


def test_a_phrase_of_many_items_costs_no_more_than_one(spark):
    """100,000 items begin with one phrase; a text holds it 10,000 times, never a whole window of an item."""
    import resource
    import time

    phrase = "please choose the correct answer from the list below"
    items = [(str(i), f"{phrase} w{i} x{i} y{i} z{i}") for i in range(100_000)]
    index = decontam.build_index(items, 10, 5)
    text = " ".join(f"{phrase} other{i % 7}" for i in range(10_000))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    (n, spans, found), (_, hit, one) = decontam.mark([text, f"{text} {phrase} w5 x5"], index)
    assert time.perf_counter() - began < 5 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    assert n == 100_000 and not spans and not found and one == {5} and hit == [(100_000, 100_011)]
    # the same as a table: the phrase meets no item
    docs = spark.createDataFrame([(1, text[:20_000]), (2, f"{phrase} w5 x5"), (3, f"a {phrase} w6 b")], "doc_id long, text string")
    bench = spark.createDataFrame(items[:2000], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.digest(decontam.contamination(docs, bench, block_bytes=0)).collect()}
    assert got == {1: (0, 0), 2: (11, 1), 3: (10, 1)}


def test_places_around_hits():
    import numpy as np

    for at, n, end in ([3, 4, 20, 22, 50], 6, 48), ([0], 6, 3), ([], 6, 10), ([9, 10], 1, 10), ([2], 6, 0):
        want = sorted({p for x in at for p in range(x - n + 1, x + 1) if 0 <= p < end})
        assert decontam.around(np.array(at, np.int64), n, end).tolist() == want
