from __future__ import annotations

import hashlib
import html
import random
import re
import time
from collections import Counter

import pytest
from conftest import SF

from millrace.llm import collocations, fill_in_middle, html_text

# ---- HTML


def text_of(page, template=frozenset()):
    return html_text.main_text(html_text.parse(page), set(template))


def test_given_pages_give_their_articles(spark):
    """The given pages hold one article each, whose blocks are h1 and p."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extracted(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
    assert len(got) == pages.count()


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div><div class="with-sidebar"><main><article class="post-12">
<header><h1>The title</h1><p>by someone</p></header><p>First &amp; second<br>line &eacute;&#33;&nbsp;end<p>Next <b>bold <i>text</b> here</p>
<script>var p = "</p><p>no</p>";</script><!-- <p>none</p> --><ul><li>one<li>two</ul><div class="ad">Buy</div><p>in<span class="share">share it</span>side <span hidden>x</span>
<table><tr><td>a<td>b</table><blockquote>5 < 6 and "q"</blockquote><form><p>mail</p></form><section id="comments"><article><p>first!</p></article></section>
<article><p>reader</p></article><footer>About the author</footer></article><aside>More</aside></main></div><footer>&copy; us</footer></body></html>"""


def test_a_page_with_everything():
    want = ["The title", "First & second line é! end", "Next bold text here", "one", "two", "inside", "a", "b", '5 < 6 and "q"']
    assert text_of(PAGE.format()).split("\n\n") == want


@pytest.mark.parametrize("page,want", [
    ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("<article>cut <p>of", "cut\n\nof"), ("<article><p>x</p><a href='y", "x"), ("<article>a <b", "a"),
    ("<article><p>a > b & c &am &amp d</p>", "a > b & c &am & d"), ("<article><p title='a>b'>t</p></article>after", "t"), ("<article></b></div><p>x</i></p></article>", "x"),
    ("<main><h1>H</h1><div class='share'>s</div><article>t</article></main>", "H\n\nt"), ("<div id=related><article>other</article></div><article>own</article>", "own"),
    ("<article><script>never ends <p>x", ""), ("<article>a<!-- never ends", "a"), ("<article><header>no<h2>yes</h2></header>t</article>", "yes\n\nt"),
    ("<body><nav>m</nav><div><h1>Own</h1></div><div class='x'><p>long text of it</p><p>and more of it</p></div><div>tiny</div>", "Own\n\nlong text of it\n\nand more of it"),
])
def test_small_pages(page, want):
    assert text_of(page) == want


def test_odd_markup_takes_time_in_proportion():
    began = time.perf_counter()
    deep = text_of("<article>" + "<div>" * 20_000 + "x" + "</div>" * 10_000 + "<p>y")
    assert deep == "x\n\ny"
    for page in ("<a <a " * 30_000, "<p class='" * 30_000, "<b>" * 30_000 + "<p>" * 1000, "</p>" * 50_000, "<" * 100_000, "&" * 50_000, "<li>" * 30_000, "<!--" * 50_000):
        text_of("<article>" + page)
    assert time.perf_counter() - began < 20


def _site(host, n, body):
    return [(k, f"https://{host}/{k}", body(k)) for k in range(n)]


def test_template_without_names(spark):
    """No element is named: what the host repeats goes, what its pages hold stays."""
    r = random.Random(3)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    own = [[say(30), say(40), "A passage that many pages quote " * 4 if k % 2 else say(20)] for k in range(12)]
    page = lambda k: f"<html><body><div><p>Welcome to our site</p><p>Choose</p></div><div><div>{''.join(f'<p>{t}</p>' for t in own[k])}</div><p>Call us now</p></div><div><p>All rights</p></div></body></html>"
    rows = _site("Plain.example.com", 12, page) + [(100, "https://alone.example.com/", page(0)), (101, None, "<p>no host</p>"), (None, "x", None), (3, "https://plain.example.com/3", page(3))]
    pages = spark.createDataFrame([(*row, "e", 5, "z") for row in rows], "page_id long, url string, html string, host string, n long, template string")
    got = html_text.extracted(pages).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    for x in got:
        if x.url and "lain" in x.url:
            assert x.text == "\n\n".join(t.strip() for t in own[x.page_id]), x
    assert {x.text for x in got if x.page_id in (101, None)} == {"no host", ""}
    template = html_text.classes(pages).where("host = 'plain.example.com' and is_text").collect()
    assert len(template) == 4 and {t.size for t in template} == {max(t.size for t in template)}
    assert html_text.extracted(pages.where("false")).count() == 0


def test_copies_of_a_page_do_not_make_a_template(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = _site("copies.example.com", 9, lambda k: f"<body><div><p>{text}</p><p>Same words here</p></div><p>{k}</p></body>")
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(x.text == f"{text}\n\nSame words here" for x in got)


def test_vectors_equal_plain_ones(spark):
    """Classes by sums of hashes are those by whole vectors."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    vectors = {}
    for r in pages.select(html_text.host_of().alias("host"), "html").collect():
        page = html_text.parse(r.html)
        for token, (_, is_text, n) in html_text.tokens(page).items():
            own = vectors.setdefault((r.host, token), {})
            own[html_text.page_key(page)] = max(n, own.get(html_text.page_key(page), 0))
    want, got = {}, {}
    for (host, token), v in vectors.items():
        want.setdefault((host, tuple(sorted(v.items()))), set()).add(token)
    for r in html_text.occurrences(pages).collect():
        got.setdefault((r.host, r.pages, r.s1, r.s2), set()).add(r.token)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


# ---- ropes


def _height(rope):
    if rope.left is None:
        return 0
    a, b = _height(rope.left), _height(rope.right)
    assert abs(a - b) <= 1 and rope.units == rope.left.units + rope.right.units and rope.chars == rope.left.chars + rope.right.chars
    return max(a, b) + 1


@pytest.mark.parametrize("unit", [None, r"\S+", r"[a-c]+|\n", "é"])
def test_ropes_split_and_join(unit):
    r = random.Random(5)
    ropes = fill_in_middle.Ropes(unit, leaf=4)
    for _ in range(400):
        text = "".join(r.choice("abcé \n\U0001f600") for _ in range(r.randrange(0, 120)))
        rope = ropes.build(text)
        assert ropes.text(rope) == text
        ends = [0, *(m.end() for m in re.finditer(unit, text))] if unit else range(len(text) + 1)
        rank = r.randrange(0, len(ends) + 1)
        at = ends[rank] if rank < len(ends) else len(text)
        a, b = ropes.split(rope, rank)
        assert (ropes.text(a), ropes.text(b)) == (text[:at], text[at:])
        again = fill_in_middle.join(b, a)
        assert ropes.text(again) == text[at:] + text[:at]
        for x in (rope, a, b, again):
            assert x is None or _height(x) == x.height
        at = r.randrange(0, len(text) + 1)
        a, b = ropes.split(rope, at, chars=True)
        assert (ropes.text(a), ropes.text(b)) == (text[:at], text[at:])


def test_fill_in_middle_equals_slices(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(20, "has <M> inside"), (21, "<"), (22, "S><S" * 40), (23, "ab" * 300_000)], "doc_id long, text string")
    rows = [(r.doc_id, r.text or "") for df in (odd_docs.select("doc_id", "text"), extra) for r in df.collect()]
    want = []
    for doc_id, t in rows:
        digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
        n = len(t)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(t)))
    got = fill_in_middle.fill_in_middle_report(odd_docs.select("doc_id", "text").unionByName(extra)).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert fill_in_middle.fill_in_middle_report(no_docs).count() == 0


def test_word_units_come_back(spark, odd_docs):
    made = fill_in_middle.transformed(odd_docs, unit=r"\s*\S+")
    back = fill_in_middle.restored(made, ("doc_id", "text"))
    assert back.where("not restored <=> coalesce(text, '')").count() == 0
    assert {r.form for r in made.collect()} >= {"plain", "psm"}


# ---- collocations


def brute_collocations(rows, top, min_count):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    cands = {x: n for x, n in counts.items() if len(x[1]) > 1 and n >= min_count}
    covered = set()
    for (lang, w), n in cands.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * n >= 80 * counts[lang, w[i : i + k]]:
                    covered.add((lang, w[i : i + k]))
    out = {}
    for (lang, w), a in cands.items():
        if (lang, w) not in covered:
            score, _, l, r = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, totals[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1))


def test_collocations_equal_brute_force(spark, monkeypatch):
    r = random.Random(2)
    vocabulary = ["New", "york", "city", "é", "Ünter", "a", "the", "\x85", "x y", "co-op", "\U0001f600", "￮"]
    rows = []
    for i in range(120):
        text = "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ". ", ", ", "\n"]) for _ in range(r.randrange(0, 80)))
        rows.append((r.choice(["en", "de", None, ""]), text if i % 17 else None))
    docs = spark.createDataFrame([(*x, "p", "q", 3) for x in rows], "lang string, text string, phrase string, h string, n int").repartition(5)
    got = collocations.collocations(docs, top=40, min_count=5).collect()
    want = brute_collocations(rows, 40, 5)
    assert want and sorted(map(tuple, got)) == want
    monkeypatch.setattr(collocations, "MOST_BITS", 64)  # a full bitmap lets all through, and changes nothing
    assert sorted(map(tuple, collocations.collocations(docs, top=40, min_count=5).collect())) == want
    assert collocations.collocations(docs, min_count=10**6).count() == 0
    assert collocations.collocations(docs.where("false")).count() == 0


@pytest.mark.parametrize("held", [25, 10**6])
def test_chunks_cut_at_piece_ends(monkeypatch, held):
    monkeypatch.setattr(collocations, "CHUNK", 20)
    monkeypatch.setattr(collocations, "MOST_HELD", held)
    texts = [("en", "one two, three four five. six"), ("de", "x" * 50 + " y"), ("en", ""), ("fr", "a;b;c;d;e;f;g;h;i;j;k;l")]
    own = collocations._Held()
    found = [x for lang, t in texts for x in own.add(lang, t)] + list(own.rest())
    pieces = sorted((lang, p) for lang, c in found for p in c.split(b"\xff") if p.strip())
    assert pieces == sorted((lang, p.encode()) for lang, t in texts for p in re.split("[.,;]", t) if p.strip())


def test_scores_past_64_bits(spark):
    big = 6 * 10**13
    table = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1), ("en", "", 0, 3 * big)], "lang string, phrase string, k int, n long")
    assert collocations.scored(table).first().score == 2_000_000 * (big - 1) // (2 * big)
