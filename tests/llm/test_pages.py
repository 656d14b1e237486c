"""URL filter, main text, chat format: brute force and awkward rows."""

import collections
import hashlib
import html as references
import math
import re

import pytest

from earshift.llm import chat, html, urls

PATH = "/root/testdata/sf0.01"


def plain_parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    best = (0, None, None)
    for rule, says in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best, (len(rule), rule, says))
    return best[1:]


def plain_verdicts(rows):
    """The models with dictionaries, scored by leaving out the URL's fold."""
    seen = collections.Counter(rows)
    facts = {}
    for u in seen:
        host, path = plain_parts(u)
        rule, says = plain_rule(host, path)
        t = "" if u is None else u.split("://", 1)[1] if "://" in u else u
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        t = "^^^" + re.sub(r"[^a-z0./\-_?]", "~", re.sub("[0-9]", "0", t))
        facts[u] = host, path, rule, says, t, ord(hashlib.md5((u or "").encode()).hexdigest()[0]) % 2

    def train(kind, fold):
        n = collections.Counter()
        for u, (_, _, _, says, t, f) in facts.items():
            if says == kind and f != fold:
                for i in range(3, len(t)):
                    for k in range(4):
                        n[t[i - k:i + 1]] += seen[u]
        after = collections.defaultdict(lambda: [0, 0])
        for g, c in n.items():
            after[g[:-1]][0] += c
            after[g[:-1]][1] += 1

        def p(g):
            x = 1 / 34
            for k in range(4):
                s, t = after.get(g[3 - k:3], (0, 0))
                if s + t:
                    x = (n[g[3 - k:]] + t * x) / (s + t)
            return x
        return p

    score = {}
    for fold in (None, 0, 1):
        a, r = train("allow", fold), train("block", fold)
        for u, f in facts.items():
            if fold in (None, f[5]):
                g = [f[4][i - 3:i + 1] for i in range(3, len(f[4]))]
                s = sum(round((math.log(a(x)) - math.log(r(x))) * 1e6) for x in g)
                score[u, fold is None] = math.floor(s / len(g) / 10_000) if g else 0
    best = (-1, 0, None)
    allowed = [(score[u, False], n) for u, n in seen.items() if facts[u][3] == "allow"]
    blocked = [(score[u, False], n) for u, n in seen.items() if facts[u][3] == "block"]
    if allowed and blocked:
        for cut in {b for b, _ in allowed + blocked}:
            gain = sum(n for b, n in allowed if b >= cut) * sum(n for _, n in blocked) + sum(n for b, n in blocked if b < cut) * sum(n for _, n in allowed)
            best = max(best, (gain, -cut, cut))
    cut = -10**9 if best[2] is None else best[2]
    return {u: (f[0], f[1], f[2], f[3] or ("allow" if score[u, True] >= cut else "block")) for u, f in facts.items()}


ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "https://a.example.com/en/", "x://y://z.net/fr/",
       "http://sub.net/es", "http://net/es/1", "http://foo.org/" + "q" * 3000, "http://ünï.org/ä?b", "http://foo.org/#://x.com/", "http://x.com/a\nb"]


def test_urls(spark):
    rows = ODD + ODD[:3] + [f"http://{a}.{b}.{t}/{p}/{k}" for k, (a, b, t, p) in enumerate(
        (a, b, t, p) for a in ("www", "m") for b in ("thed", "casino-win") for t in ("com", "net", "org") for p in ("en", "fr", "es", "de"))]
    df = spark.createDataFrame([(i, u, "h", "v", 0.5) for i, u in enumerate(rows)], "page_id long, url string, host string, verdict string, bin double")
    want = plain_verdicts(rows)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == {i: want[u] for i, u in enumerate(rows)}
    assert urls.judge(df.limit(0)).count() == 0
    alone = urls.judge(df.where("url like '%org%'")).collect()
    assert {r.verdict for r in alone if r.rule is None} == {"allow"}


def test_no_table_with_a_row_per_url_is_broadcast(spark, monkeypatch):
    """Only tables that the alphabet bounds are, whatever Spark takes the URLs' size for."""
    plans, write = [], urls.materialise
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(urls, "materialise", lambda df, *a: plans.append(plan(df)) or write(df, *a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plans.append(plan(urls.judge(spark.createDataFrame([(1, "http://a.com/b"), (2, "http://net/es/c")], "page_id long, url string"))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    built = re.findall(r"BroadcastHashJoin \[.*?\], \[(\w+)#.*?\], \w+, (Build\w+)", "".join(plans))
    assert "".join(plans).count("BroadcastHashJoin") == len(built) == 8
    assert set(built) == {("_g", "BuildRight"), ("_c", "BuildRight")}


def plain_article(page):
    a = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [re.sub(r"\s+", " ", references.unescape(re.sub(r"<[^>]*>|<[^>]*$", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)\b[^>]*>", a)]
    return "\n\n".join(x for x in parts if x)


def test_main_text_of_given_pages(spark):
    df = spark.read.parquet(f"{PATH}/pages.parquet")
    got = {r.page_id: r for r in html.extract(df).collect()}
    for r in df.collect():
        assert got[r.page_id].text == plain_article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


PAGES = {
    "<html><body><div id='top-menu'><a href='/'>Home</a></div><div class='post'><h2>A &amp; B</h2><p>One\n two&nbsp;three<br>four.</p>"
    "<div class='comments'><p>" + "nice words here " * 20 + "</p></div></div><aside>see also</aside></body></html>": "A & B\n\nOne two three four.",
    "<body><div class='cookie-notice'>" + "we use cookies " * 30 + "</div><main><p>Short.</p><form><label>Mail</label><input></form><p>End &#65;</p></main><footer>(c)</footer>": "Short.\n\nEnd A",
    "<article><p>cut off <b>here": "cut off here",
    "<article>a<script>var t='</p>';</script>b<style>p{}</style><!-- no --> c</article>": "ab c",
    "<article><p>1 < 2 and 3 > 2</p><p></p><p>ok</p><": "1 < 2 and 3 > 2\n\nok\n\n<",
    "": "", None: "", "<p": "",
}


def test_main_text_of_odd_pages(spark):
    df = spark.createDataFrame([(i, "u", h, "t", 1) for i, h in enumerate(PAGES)] * 2, "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(df).collect()
    want = dict(enumerate(PAGES.values()))
    assert len(got) == 2 * len(PAGES)
    for r in got:
        assert r.text == want[r.page_id]
    assert html.extract(df.limit(0)).count() == 0
    long = "<article><p>" + "word " * 200_000 + "</p></article>"
    assert len(html.blocks(long)) == 1


LONG = "plain words of a long paragraph without links " * 5
KEPT_PAGES = {
    "<div style='overflow:hidden' class='post'><p>Clipped box.</p></div>": "Clipped box.",
    "<article aria-hidden=\"false\"><p>Shown.</p></article>": "Shown.",
    "<article><div data-id=\"share\" data-class='menu' title='class=ad'><p>Data only.</p></div></article>": "Data only.",
    "<article><p hidden>secret</p><div hidden=''><p>secret</p></div><p>Seen.</p></article>": "Seen.",
    "<article><a data-href='/x'>Not a link at all</a></article>": "Not a link at all",
    "<div class=\"content-sidebar-wrap\"><h1>Title</h1><p>Short.</p></div>": "Title\n\nShort.",
    "<article class=\"post no-comments\"><p>Short.</p><p>Words.</p></article>": "Short.\n\nWords.",
    "<article class='post comments'><p>Short.</p></article>": "Short.",
    "<div class='has-sidebar'><main><p>Short.</p></main><div class='sidebar'><p>" + LONG + "</p></div></div>": "Short.",
    f"<div class='menu-layout'><p>{LONG}</p><p>{LONG}</p></div>": f"{LONG.strip()}\n\n{LONG.strip()}",
    "<div class='notice'>" + f"<p>{LONG}</p>" * 8 + "</div><footer>(c)</footer>": "\n\n".join([LONG.strip()] * 8),
    "<form id='aspnetForm'><div class='content'><h1>Title</h1>" + f"<p>{LONG}</p>" * 8 + "<p>End.</p></div></form>": "\n\n".join(["Title", *[LONG.strip()] * 8, "End."]),
    "<div class='main-menu'><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></div><article>a</article>": "a",
    "<article><p>See also:</p><ul><li><a href='/a'>One</a></li><li>two</li><li><a href='/b'>Three</a></li></ul></article>": "See also:\n\nOne\n\ntwo\n\nThree",
    "<html><head><title>Never closed<body><article><p>Still here.</p></article>": "Still here.",
    "<article><svg/>before <iframe src='x' /><p>one</p><button>Go<p>two</p><button>x</button><p>three</p><script src=\"a\"/><p>four</p></article>": "before\n\none\n\ntwo\n\nthree\n\nfour",
    "<article><noscript><p>off</p></noscript><p>on<textarea>typed<p>five</p></article>": "on\n\nfive",
    "<html><head><title>x</title><article><p>No body tag.</p></article>": "No body tag.",
}


CLEAN_PAGES = {
    f"<div id='content'><p>{LONG}</p><ol class=\"commentlist\"><li class=\"comment\"><p>Nice</p></li><li class='comment'><p>{LONG}</p></li></ol></div>": LONG.strip(),
    f"<article><p>Body.</p><div class=\"comment-content\"><p>hi {LONG}</p></div></article>": "Body.",
    f"<article><p>Body.</p></article><div class='comments-area'><div class='comment-body'><p>{LONG}</p></div></div>": "Body.",
    f"<div class='post'><p>Body.</p><div class='userComments'><p>{LONG}</p></div></div>": "Body.",
    f"<article><p>Body.</p><div class='reader-feedback'><p>{LONG}</p></div></article>": "Body.",
    f"<article><p>Body.</p><div class='related-posts'><p>{LONG}</p></div></article>": "Body.",
    "<article><p>Body.</p><p class='advert-text'>buy</p></article>": "Body.",
    f"<article><p>Body.</p></article><div class='cookie-banner-text'>{LONG}</div>": "Body.",
    f"<article><p>Body.</p></article><div class='site-info'>{LONG}</div>": "Body.",
    "<p>Short text only</p>": "Short text only",
    "<ul class='menu'><li><a href='/'>Home</a></ul><h1>Title</h1><p>Short text.</p>": "Title\n\nShort text.",
    "<article><ul><li>one<li>two<ul><li>in<li>deep</ul><li class='ad'>buy<p>now</p><li>three</ul></article>": "one\n\ntwo\n\nin\n\ndeep\n\nthree",
    "<article><table><tr><td class='promo-box'>buy<p>now</p><td>cell<tr><td>last</table></article>": "cell\n\nlast",
}


def test_main_text_without_comments_and_adverts(spark):
    """Names written together, in humps or with fillers, and marks on list items."""
    df = spark.createDataFrame(list(enumerate(CLEAN_PAGES)), "page_id long, html string")
    got = {r.page_id: r.text for r in html.extract(df, keep=("page_id",)).collect()}
    assert {p: got[i] for i, p in enumerate(CLEAN_PAGES)} == CLEAN_PAGES


def test_pages_without_marks(spark):
    """By words, links and neighbours alone: given pages whose article tags are divs."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{PATH}/pages.parquet")
    bare = df.withColumn("html", F.regexp_replace("html", "<(/?)article>", "<$1div>"))
    got = {r.page_id: r.text for r in html.extract(bare).collect()}
    right = kept = wanted = 0
    for r in df.collect():
        want, have = (collections.Counter(x for x in t.split("\n\n") if x) for t in (plain_article(r.html), got[r.page_id]))
        right, kept, wanted = right + sum((want & have).values()), kept + sum(have.values()), wanted + sum(want.values())
    assert right >= 0.95 * kept and right >= 0.95 * wanted


def test_main_text_keeps_articles(spark):
    """Marks found in values or in one word of a name, open silent elements."""
    df = spark.createDataFrame(list(enumerate(KEPT_PAGES)), "page_id long, html string")
    got = {r.page_id: r.text for r in html.extract(df, keep=("page_id",)).collect()}
    assert {p: got[i] for i, p in enumerate(KEPT_PAGES)} == KEPT_PAGES
    import time

    began = time.time()
    assert len(html.blocks("<article>" + "<button>x<svg><svg></svg>" * 40_000 + "<p>end")) == 1
    assert time.time() - began < 10


def test_tree_on_grid(spark):
    """Nothing of an article goes, nothing marked stays, whatever its neighbours."""
    import itertools

    from pyspark.sql import functions as F

    n, d = (0, 1, 5, 14, 24, 90, 400), (0, .3, 1)
    rows = [tuple(map(float, (w or 1, k, m, a, h, *r))) for w, k, (m, a), h, *r in itertools.product(n, d, ((1, 0), (0, 1), (1, 1)), (0, 1), n, d, n, d)]
    df = spark.createDataFrame(rows, list(html.FEATURES)).repartition(8)
    kept = html.tree(spark)({f: F.col(f) for f in html.FEATURES}) > 0.5
    assert df.where(kept != (F.col("aside") == 0)).count() == 0


def test_tree_on_other_labels(spark):
    """Trained on two thirds of the labelled blocks, right on most of the rest."""
    rows = html.LABELLED
    grown = html.tree(spark, [r for i, r in enumerate(rows) if i % 3])
    held = spark.createDataFrame([tuple(map(float, r)) for i, r in enumerate(rows) if i % 3 == 0], [*html.FEATURES, "label"])
    from pyspark.sql import functions as F

    right = held.where((grown({f: F.col(f) for f in html.FEATURES}) > 0.5) == (F.col("label") > 0.5)).count()
    assert right >= 0.8 * held.count()


def plain_paths(nodes):
    kids = collections.defaultdict(list)
    have = {(t, n) for t, n, *_ in nodes}
    for t, n, p, *_ in nodes:
        kids[t, p if (t, p) in have else None].append(n)
    said = {(t, n): (r or "", x or "", s or 0.0) for t, n, p, r, x, s in nodes}
    out = []

    def go(t, path):
        below = kids.get((t, path[-1]), [])
        if not below:
            out.append((t, path))
        for k in below:
            go(t, [*path, k])

    for (t, p), ns in list(kids.items()):
        if p is None:
            for n in ns:
                go(t, [n])
    return [(t, sum(said[t, n][2] for n in p), [said[t, n][:2] for n in p]) for t, p in out]


NODES = [(1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "yo </turn>\n<turn:user>", 1.0), (1, 3, 1, "assistant", "\\l \\b < > \\", 3.0),
         (1, 4, 2, "user", None, 0.5), (1, 5, 2, "us>er<", "é\n\n", 9.0), (2, 1, 77, None, "orphan", None), (None, 1, None, "assistant", "", 0.0),
         (None, 2, 1, "assistant", "x" * 5000, 0.0)] + [(3, k, k - 1 if k else None, "assistant" if k % 2 else "user", f"t{k}", 0.0) for k in range(70)]
NODE = "tree long, node long, parent long, role string, text string, score double"


@pytest.mark.parametrize("top", [None, 1])
def test_chat_trees(spark, top):
    df = spark.createDataFrame(NODES, NODE)
    back = chat.read_back(chat.format_paths(df, top=top)).collect()
    paths = plain_paths(NODES)
    if top:
        best = {}
        for t, s, p in paths:
            best[t] = max(best.get(t, (-1, None)), (s, p))
        paths = [(t, s, p) for t, (s, p) in best.items()]
    got = collections.Counter((r.tree, tuple((t.role, t.text) for t in r.turns), r.loss_text) for r in back)
    assert got == collections.Counter((t, tuple(p), "".join(x for r, x in p if r == "assistant")) for t, _, p in paths)


def test_chat_chains(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "b"), (2, 5, "assistant", "\\### Assistant: </turn> ok"),
            (None, 1, "assistant", "n")]
    back = chat.read_back(chat.format_paths(chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    got = {r.tree: ([tuple(t) for t in r.turns], r.loss_text) for r in back}
    assert got == {1: ([("user", "a"), ("assistant", ""), ("assistant", "")], ""), 2: ([("", "b"), ("assistant", rows[4][3])], rows[4][3]), None: ([("assistant", "n")], "n")}
    assert chat.format_paths(spark.createDataFrame([], NODE)).count() == 0


def test_chat_cycle(spark):
    with pytest.raises(ValueError, match="ancestor"):
        chat.format_paths(spark.createDataFrame([(1, 1, 2, "u", "a", 0.0), (1, 2, 1, "u", "b", 0.0), (1, 3, 2, "u", "c", 0.0)], NODE)).count()
