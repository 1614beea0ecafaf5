"""Tokens, languages, quality, pages, benchmark passages and repeated passages against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text, substring_dedup
from tessera.llm.decontaminate import ItemIndex, contaminated, matches
from tessera.llm.decontaminate import words_of as words_of_text
from tessera.llm.html_text import extract_text, main_text, window_regions
from tessera.llm.language_id import START, UNKNOWN, PieceModel, codes, identify_languages
from tessera.llm.quality import FEATURES, Forest, boost, score_quality, statistics
from tessera.llm.text import id_slice
from tessera.llm.tokens import VOCABULARY, TokenCounter, count_tokens, load, whole_tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clashing(df):
    return df.selectExpr("*", *[f"0 as {c}" for c in ("id", "h", "x", "p", "m", "text_1", "score", "n_words")])


def test_token_counts_equal_the_library(docs, no_docs):
    lib = load(VOCABULARY)
    rows = docs.collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    got = count_tokens(clashing(docs)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert count_tokens(no_docs).count() == 0


def test_token_counter_on_odd_text():
    rng = random.Random(2)
    letters = "abcXYZ'’éÉßİiΣσς  \t\n\r\x0b\x85\xa0\x1c\u0107À0123½²*#!?.,-_😀日本кИ<|>\u200b\ufeff\u0307'sS're"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["a <|endoftext|> b<|startoftext|>", "It's DON'T 'Re '''s x'S", "", " "]
    lib, counter = load(VOCABULARY), TokenCounter(VOCABULARY, whole_tokens())
    assert [counter.count(t) for t in texts] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_language_id_on_held_out_rows(spark, no_docs):
    rng = random.Random(4)
    stems = {"aa": "ka ki ku sha tor men".split(), "bb": "ble qui zo wen ly drap".split(), "cc": "é ña oui vur gel ston".split()}
    rows = [(i, " ".join("".join(rng.choices(stems[g], k=3)) for _ in range(rng.randint(3, 30))), g) for i in range(300) for g in [rng.choice(list(stems))]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, "kaki", None), (1005, "½ ²", "aa"), (1006, "Ⅷ ③ 12", "aa"), (None, "kakisha", "aa"), (1004, "k" * 5000, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify_languages(clashing(df.withColumnRenamed("score", "s")), ~id_slice("doc_id", 4, 2)).collect()
    assert len(got) == len(rows)
    want = {i: g for i, _, g in rows if i is not None and i < 300}
    held = [r for r in df.select("doc_id", id_slice("doc_id", 4, 2).alias("h")).collect() if r.h]
    held = {r.doc_id for r in held} & set(want)
    assert len(held) > 40
    right = [r.lang_pred == want[r.doc_id] for r in got if r.doc_id in held]
    assert sum(right) / len(right) > 0.98
    odd = {r.doc_id: r for r in got}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (1000, 1001, 1002, 1005, 1006))
    assert all(0 <= r.score <= 1 for r in got)
    assert identify_languages(no_docs, F.lit(True)).count() == 0
    assert {r.lang_pred for r in identify_languages(df, F.lit(False)).collect()} == {"und"}


def test_words_sum_all_their_segmentations():
    import numpy as np

    rng = np.random.default_rng(5)
    pieces = [START, START + "k", START + "ka", "k", "a", "ka", "ki", "i", "aki", "kaki", "sh"]
    model = PieceModel(["aa", "bb"], pieces)
    table = {p: rng.random(2) / 20 for p in pieces}
    order = [int(model.lookup(codes([p.removeprefix(START)])[0])[len(p) - 1][0, 0]) if p.startswith(START) else -1 for p in pieces]
    for p, at in zip(pieces, order, strict=True):
        if at < 0:
            at = int(model.lookup(codes(["x" + p])[0])[len(p) - 1][0, 2])
        model.p[at] = table[p]

    def every(rest):
        if not rest:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(rest) + 1):
            p = table.get(rest[:k], np.zeros(2))
            total = total + (np.maximum(p, UNKNOWN) if k == 1 else p) * every(rest[k:])
        return total

    words = ["k", "kaki", "kakika", "zz", "shaki", "akakiaki", "a"]
    assert np.allclose(model.log_words(words), np.log([every(START + w) for w in words]))


def test_quality_on_held_out_rows(spark, no_docs, prose_of):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(300):
        good = rng.random() < 0.7
        text = prose_of(rng, rng.randint(5, 80))
        rows.append((i, text if good else " ".join(w + "###" for w in text.split())))
        marks.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "x" * 100_000), (None, "no id"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (7, None, 1), (8, marks[8][1], 1)], "doc_id long, quality int, toxic int")
    got = score_quality(clashing(docs), labels, lambda c: ~id_slice(c, 3, 1)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = {r.doc_id for r in docs.where(id_slice("doc_id", 3, 1)).collect()}
    right = [r.predicted == marks[r.doc_id][1] for r in got if r.doc_id in held and r.doc_id < 300]
    assert len(right) > 60 and sum(right) / len(right) > 0.95
    assert {r.score for r in score_quality(docs, labels.limit(0), lambda c: F.lit(True)).collect()} == {0.5}
    assert score_quality(no_docs, labels, lambda c: F.lit(True)).count() == 0


def test_flat_trees_follow_their_nodes():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = boost(x, y, trees=12, depth=3)
    raw = []
    for row in x:
        total = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while node < 2**forest.depth - 1:
                node = 2 * node + 1 + bool(row[forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.value[t, node - (2**forest.depth - 1)]
        raw.append(1 / (1 + np.exp(-total)))
    assert isinstance(forest, Forest)
    assert np.allclose(raw, forest.scores(x))
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.95
    assert len(statistics("a b\nc")) == len(FEATURES) == len(statistics("")) == len(statistics(" "))


def test_boosting_finds_the_split_that_a_search_finds():
    import numpy as np

    for seed in range(6):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 12, size=(90, 3)).astype(float)
        y = (rng.random(90) < np.where(x[:, seed % 3] > 5, 0.85, 0.2)).astype(float)
        forest = boost(x, y, trees=1, depth=1, rate=0.3, bins=16, l2=1.0, least=5)
        p = y.mean()
        grad, hess = y - p, np.full(90, p * (1 - p))
        value = lambda some: grad[some].sum() ** 2 / (hess[some].sum() + 1)  # noqa: B023, E731
        gains = {}
        edges = [(f, cut) for f in range(3) for cut in np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])]
        for f, cut in edges:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= 5:
                gains[f, cut] = value(left) + value(~left) - value(np.ones(90, bool))
        f, cut = int(forest.feature[0, 0]), forest.threshold[0, 0]
        left = x[:, f] <= cut
        assert max(gains.values()) - (value(left) + value(~left) - value(np.ones(90, bool))) < 1e-9
        for leaf, some in enumerate((left, ~left)):
            assert abs(forest.value[0, leaf] - 0.3 * grad[some].sum() / (hess[some].sum() + 1)) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice"><div>We use <b>cookies</b></div></div>%s
<div id="comments"><p>First reader comment, long enough to look like text of the article itself.</p></div>
<aside>Side bar</aside><form><input><label>Mail</label></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>A  title</h1><p>One &lt;b&gt; &amp amp.<br>two\n\tlines</p><!-- x --><p>Ti.</article>", "A title\nOne <b> & amp.\ntwo lines\nTi."),
        ("<main><p>Short.</p><div class='advert'><p>Buy</p></div><ul><li>x</li><li>y</li></ul></main>", "Short.\nx\ny"),
        ("<div><h2>Head</h2><p>" + "long text " * 20 + "</p><p>" + "more text " * 20 + "</p></div>", "Head\n" + ("long text " * 20).strip() + "\n" + ("more text " * 20).strip()),
        ("<div class='content has-sidebar no-comments'><p>" + "kept text " * 20 + "</p></div><div class='side-bar sidebar'><p>" + "dropped " * 30 + "</p></div>", ("kept text " * 20).strip()),
        ("<section id=post><h1>Head</h1><p>" + "body " * 30 + "</p></section><section class='reader-comments'><article class='comment'><p>" + "reply " * 40 + "</p></article></section>", "Head\n" + ("body " * 30).strip()),
        ("<div class=site-header>Site name</div><div class=post><div class='entry-header'><h1>Head</h1></div><p>" + "body " * 30 + "</p></div>", "Head\n" + ("body " * 30).strip()),
        ("<article><ul><li>one<li class=ad>buy<li>two</ul><p class=promo>more<p>three</article>", "one\ntwo\nthree"),
        ("<article></article>", ""),
        ("<article><p>a<b>b</b>c <a href='x>y'>link</a></p><div class=share>Share</div></article>", "abc link"),
        ("<article><h2 id='search-algorithms'>Search</h2><section id='related-work'><p>Work.</p></section><section class=discussion><p>Talk.</section></article>", "Search\nWork.\nTalk."),
        ("<article><p>One.</p><div class=ad><div>Buy</div><p>Two.</p><p>Three.</p></article>", "One.\nTwo.\nThree."),
        ("<div class=sidebar><p>Side</p><article><p>One.</p><p>Two.</p></article>", "One.\nTwo."),
        ("<div class=post><p>" + "long text " * 90 + "</p><div class=advert>Buy</div><p>The end.</p></div>", ("long text " * 90).strip() + "\nThe end."),
        ("<article><p>" + "body " * 60 + "</p></article><article class=teaser><h3>Next</h3><p>Short.</p></article>", ("body " * 60).strip()),
        ("<article class=teaser><p>Hi.</p></article><div>" + "".join("<p>" + "main text of the page " * 40 + "</p>" for _ in range(4)) + "</div>", "\n".join([("main text of the page " * 40).strip()] * 4)),
        ("<main><h1>Head</h1><div class=share>Share</div><article><p>" + "body " * 60 + "</p><div id=comments><p>Reader</p></div></article></main>", "Head\n" + ("body " * 60).strip()),
    ],
)
def test_main_text(body, text):
    assert main_text(PAGE % body) == text


LONG = "<p>" + "long text " * 90 + "</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p title="a < b">One.</p></article>', "One."),
        ('<article><p title="<script>">One.</p><p>Two.</p></article>', "One.\nTwo."),
        ("<article><p title='a > b \" c'>One.</p><script data-x='a>b'>var x</script><p>Two.</p></article>", "One.\nTwo."),
        ('<article><p title="never closed>One.</p><p>Two.</p></article>', "One.\nTwo."),
        ("<article><p>a<![CDATA[ x > y ]]>b</p></article>", "ab"),
        ("<article>" + "".join(f'<div class="{c}"><p>Kept {c}.</p></div>' for c in ("shared-memory", "alert-text", "search-tips", "legal", "form-group", "ad-hoc")) + "</article>",
         "\n".join(f"Kept {c}." for c in ("shared-memory", "alert-text", "search-tips", "legal", "form-group", "ad-hoc"))),
        ('<article><p>On <span class="social">social</span> media.</p></article>', "On social media."),
        (f"<div class=discussion-paper>{LONG}<p>End.</p></div>", ("long text " * 90).strip() + "\nEnd."),
        (f"<div class=related-topic>{LONG}<p>End.</p></div>", ("long text " * 90).strip() + "\nEnd."),
        *[(f"<div class=post>{LONG}{box}<p>The end.</p></div>", ("long text " * 90).strip() + "\nThe end.") for box in ("<nav><a href=/>x</a></nav>", "<form><input></form>", "<div class=related-posts><p>More</p></div>")],
        (f"<div class=post>{LONG}</div><div class=sidebar-widget-area>Side</div><div class=user-comments><p>Reader</p></div>", ("long text " * 90).strip()),
    ],
)
def test_markup_and_names_that_are_not_what_they_seem(page, text):
    assert main_text(f"<html><body>{page}</body></html>") == text


def plain_main_text(lines):
    """The page result from its lines, by trying all runs: brute force."""
    weight, at, last = [], [], 0
    for k, x in enumerate(lines):
        p = lines[k - 1] if k else None
        if p and (x.gap and p.holder != x.holder or p.mark != x.mark or x.article and last not in (0, x.article)):
            weight += [0, 0, 0]
        last = x.article or last
        at.append(len(weight))
        weight.append(800 + min(x.plain, 200) if x.mark else 0 if 3 * x.plain < len(x.text) else max(1, min(x.plain, 200)))
    sums = [sum(weight[i : i + 3]) for i in range(len(weight))]
    regions = []
    for a, b in itertools.combinations(range(len(weight) + 1), 2):
        if all(sums[a:b]) and not (a and sums[a - 1]) and not (b < len(weight) and sums[b]) and max(sums[a:b]) >= max(sums) / 4:
            held = [i for i in range(a, b) if weight[i]]
            regions.append([x for x, i in zip(lines, at) if held[0] <= i <= held[-1]])
    mass = [sum((4 if x.mark else 1) * max(1, x.plain) for x in r) for r in regions]
    return "\n".join(x.text for r, m in zip(regions, mass) if m >= max(mass) / 4 for x in r)


def test_page_results_equal_brute_force():
    rng = random.Random(11)
    parts = ["<p>" + "word " * 3 + "</p>", "<p>" + "word " * 60 + "</p>", "<nav><p>menu</p></nav>", "<div>", "</div>", "<p><a href=/>" + "link " * 9 + "</a></p>", "<article>", "</article>", "<section class=ad>buy</section>", "<ul><li>x<li>y</ul>"]
    kept = 0
    for _ in range(300):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        lines = html_text.page_lines(page)
        got = main_text(page)
        assert got == plain_main_text(lines)
        kept += 0 < got.count("\n") + 1 < len(lines)
    assert kept > 20


def test_regions_match_all_windows():
    rng = random.Random(3)
    some = False
    for _ in range(500):
        weight = [rng.choice([0, 0, 0, 5, 40, 200]) for _ in range(rng.randint(0, 30))]
        for window, share in ((1, 0.25), (3, 0.25), (3, 1.0), (5, 0.0)):
            sums = [sum(weight[i : i + window]) for i in range(len(weight))]
            runs = [list(g) for k, g in itertools.groupby(range(len(weight)), lambda i: sums[i] > 0) if k]
            want = []
            for run in runs:
                held = [i for i in run if weight[i]]
                if max(sums[i] for i in run) >= share * max(sums):
                    want.append((held[0], held[-1]))
            assert window_regions(weight, window, share) == want
            some = some or window_regions(weight, 1, share) != want
    assert some


def test_windows_decide_what_is_kept(monkeypatch):
    page = "<article><p>Short news.</p></article><div>" + "".join(f"<div>{k} " + "an aside without a name " * 4 + "</div>" for k in range(3)) + "</div>"
    with_three = main_text(page)
    assert with_three.count("\n") == 2 and "Short" not in with_three
    monkeypatch.setattr(html_text, "WINDOW", 1)
    assert main_text(page) == "Short news."


def test_long_pages_take_time_in_proportion():
    page = "<div class=ad>" * 20_000 + "<article>" + "<p>word</p>" * 50_000 + "</article>"
    assert main_text(page).count("word") == 50_000
    assert main_text("<p class=ad>" * 20_000 + "</div>" * 20_000) == ""


def test_extract_text_keeps_every_row(spark):
    rows = [(1, "u", PAGE % "<article><p>é</p></article>"), (1, "u", PAGE % "<article><p>é</p></article>"), (2, None, None), (None, "v", ""), (3, "w", "<<<p"), (4, "x", "<script>" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as id")
    got = extract_text(df).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got if r.page_id != 3) == [("1", "é", 1), ("1", "é", 1), ("2", "", 0), ("4", "", 0), ("None", "", 0)]
    assert extract_text(df.limit(0)).count() == 0


def test_contaminated_takes_ids_of_any_type(spark, prose_of):
    text = prose_of(random.Random(1), 30)
    docs = spark.createDataFrame([(1, "intro " + text), (2, "other words of a text")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text)], "n long, text string")
    for kind in ("int", "smallint", "string", "double", "decimal(9,2)"):
        got = contaminated(docs, items.selectExpr(f"cast(n as {kind}) as item_id", "text")).collect()
        assert [(r.doc_id, float(r.item_id)) for r in got] == [(1, 7.0)]
    got = contaminated(docs, items.selectExpr("date'2020-01-01' as item_id", "text"))
    assert got.count() == 1 and dict(got.dtypes)["item_id"] == "date"


def test_contaminated_documents_are_found(spark, no_docs, prose_of):
    rng = random.Random(8)
    items = [(i, prose_of(rng, n)) for i, n in enumerate([3, 5, 15, 20, 30, 40, 56])] + [(7, None), (8, ""), (9, "...")]
    rows, want = [], set()
    for d in range(70):
        w = prose_of(rng, rng.randint(60, 200)).split()
        i = d % 10
        if d < 40 and i < 7:
            passage = items[i][1].upper().split()
            if d >= 20 and i >= 4:
                passage[2] = "other"
            at = rng.randrange(len(w))
            w[at:at] = passage
            want.add((d, i))
        rows.append((d, " ".join(w)))
    rows += [(100, None), (101, ""), (102, items[6][1] + " tail"), (None, items[5][1]), (103, "x " * 40_000 + items[4][1])]
    want |= {(102, 6), (None, 5), (103, 4)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(clashing(docs), clashing(bench)).collect()
    want -= {(d, i) for d, i in want if d is not None and 20 <= d < 40 and i == 4}
    assert {(r.doc_id, r.item_id) for r in got if not (r.doc_id is not None and 20 <= r.doc_id < 40 and r.item_id == 4)} == want
    assert all(0.8 <= r.similarity <= 1 for r in got)
    many = contaminated(docs, bench, block_bytes=200).collect()
    assert sorted(map(str, many)) == sorted(map(str, got))
    assert contaminated(no_docs, bench).count() == contaminated(docs, bench.limit(0)).count() == 0


def brute_matches(text, item, width=5, threshold=0.8):
    """Best window of the item's length, by its weighted shingle similarity, then its place."""
    from collections import Counter

    w, v = words_of_text(text), words_of_text(item)
    if not w or not v:
        return None
    k, n = min(width, len(v)), min(len(v), len(w))
    want = Counter(tuple(v[i : i + k]) for i in range(len(v) - k + 1))
    best = None
    for a in range(len(w) - n + 1):
        have = Counter(tuple(w[i : i + k]) for i in range(a, a + n - k + 1))
        both = sum((have & want).values())
        s = both / max(1, sum(have.values()) + sum(want.values()) - both)
        if s >= threshold and (best is None or s > best[0]):
            best = (s, a, n)
    return best


def test_contamination_matches_brute_force(spark, prose_of):
    rng = random.Random(21)
    items = [(i, prose_of(rng, rng.randint(8, 60))) for i in range(12)]
    rows = []
    for d in range(80):
        w = prose_of(rng, rng.randint(1, 120)).split()
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                p[rng.randrange(len(p))] = "edited"
            at = rng.randint(0, len(w))
            w[at:at] = p[rng.randint(0, 2) :]
        rows.append((d, " ".join(w)))
    want = {(d, i): m for d, t in rows for i, v in items if (m := brute_matches(t, v))}
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in got} == want and len(want) > 20


def brute_repeats(rows, window):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((str(d), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeated_passages_are_removed(spark, docs, no_docs, prose_of, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(9)
    shared = [prose_of(rng, n).split() for n in (12, 13, 14, 25, 60)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for d in range(200, 260):
        w = prose_of(rng, rng.randint(0, 60)).split()
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 3)
            at = rng.randint(0, len(w))
            w[at:at] = p[a : len(p) - rng.randint(0, 3)]
        rows.append((d, " ".join(w)))
    rows += [(300, "a " * 40), (299, "a a\ta " * 9), (300, rows[-1][1]), (300, rows[-1][1])]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = substring_dedup.remove_repeats(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows, 13)
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_suffix_automaton_statistics():
    rng = random.Random(10)
    for _ in range(60):
        automaton, held = substring_dedup.SuffixAutomaton(), []
        for _ in range(6):
            s = [rng.randint(0, 2) for _ in range(rng.randint(0, 12))]
            subs = {tuple(h[i:j]) for h in held for i in range(len(h)) for j in range(i + 1, len(h) + 1)}
            want = [max((k for k in range(1, i + 2) if tuple(s[i + 1 - k : i + 1]) in subs), default=0) for i in range(len(s))]
            assert list(automaton.statistics(s)) == want
            automaton.add(s)
            held.append(s)


def test_many_items_of_one_length_and_a_long_leak_stay_within_memory():
    """Every 30 words of a text are an item, and a third of that text is leaked: all its windows are like some items."""
    import tracemalloc

    rng = random.Random(5)
    words = [b"w%d" % rng.randrange(4000) for _ in range(9_030)]
    items = [(i, words[i : i + 30]) for i in range(9_000)]
    index = ItemIndex(items, 5, 20)
    assert index.least == 2
    tracemalloc.start()
    got = matches(words[:3_000], index, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert {i for i, (s, start, n) in got.items() if s == 1} == set(range(2_971)) and all(got[i][1:] == (i, 30) for i in range(2_971))
    want = [i for i in range(2_971, 3_040) if any(brute_pair(words[j : j + 30], words[i : i + 30]) >= 0.8 for j in range(2_960, 2_971))]
    assert sorted(set(got) - set(range(2_971))) == want


def brute_pair(a, b, k=5):
    from collections import Counter

    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)
