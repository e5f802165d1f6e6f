"""Operators on embeddings, pages and conversations against brute force."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from basketry.llm import chat, embed, html, topk
from basketry.llm.oracles import ORACLE
from tests.conftest import SMALL

VECTORS = "vec_id long, embedding array<float>, label int, score long"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 16))
    near = base[:40] + rng.normal(size=(40, 16)) * 0.05
    rows = [(i, [float(x) for x in v], i % 3, 1) for i, v in enumerate([*base, *near, *base[:10], *([base[0]] * 30)])]
    n = len(rows)
    rows += [(n, None, 0, 1), (n + 1, [], 0, 1), (n + 2, [0.0] * 16, 0, 1), (n + 3, [float("nan")] + [1.0] * 15, 0, 1), (n + 4, [float("inf")] + [1.0] * 15, 0, 1),
             (n + 5, [None] + [1.0] * 15, 0, 1), (n + 6, [1.0] * 5, 0, 1), (n + 7, [1e30] * 16, 0, 1), (n + 8, [-1e30] * 16, 0, 1), (n + 9, [1e-30] * 16, 0, 1), (n + 10, [-0.0] * 16, 0, 1),
             (400, [2.0] * 16, 0, 1), rows[7], rows[7], (None, [1.0] * 16, 0, 1)]
    return spark.createDataFrame(rows, VECTORS)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_top(rows, every, k):
    vec = sorted({(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and usable(v)})
    hold = lambda s: max(-topk.LONG_MAX, min(topk.LONG_MAX, s))
    out = []
    for i, q in vec:
        if i % every == 0:
            s = sorted((-hold(sum(a * b for a, b in zip(q, v))), j) for j, v in vec if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return Counter(out)


def test_top_k_equals_brute_force(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "SEED_ROWS", 20)
    small = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    for df, every in ((odd_vectors, 20), (small, 10)):
        rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
        assert Counter(map(tuple, topk.top_k(df, every, 10).collect())) == brute_top(rows, every, 10)
    assert topk.top_k(odd_vectors.limit(0)).count() == 0
    few = odd_vectors.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, 100, 10).count() == 2


def test_search_stops_only_on_proof():
    """Whatever the threshold, no row that reaches it is lost, and scores are exact."""
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(200, 24)) * 300).astype(np.int64)
    q = np.floor(rng.normal(size=(7, 24)) * 300).astype(np.int64)
    true = x @ q.T
    for share in (0.0, 0.5, 0.95, 0.999, 1.0):
        floor = np.quantile(true, share, axis=0).astype(np.int64)
        v, k, s = topk.search(topk.Segments(x), q, floor)
        assert (s == true[v, k]).all()
        assert set(zip(*np.nonzero(true >= floor))) <= set(zip(v, k))


def brute_links(rows, limit):
    dims = max((len(v) for _, v in rows if usable(v)), default=1)
    x = np.array([[float(a) for a in v] + [0.0] * (dims - len(v)) if usable(v) else [0.0] * dims for _, v in rows])
    big = np.abs(x).max(axis=1)
    ok = big > 0
    x[ok] /= big[ok][:, None]
    x[ok] /= np.linalg.norm(x[ok], axis=1)[:, None]
    near = (x @ x.T >= limit) & ok[:, None] & ok[None, :]
    np.fill_diagonal(near, False)
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    least = defaultdict(list)
    for i, lab in enumerate(label):
        if rows[i][0] is not None:
            least[lab].append(rows[i][0])
    comp = [min(least[lab]) if least[lab] else None for lab in label]
    return [(r[0], int(near[i].sum()), comp[i], r[0] == comp[i]) for i, r in enumerate(rows)]


def test_near_duplicates_equal_brute_force(spark, odd_vectors, monkeypatch):
    """The small tables hold all their links; a planted cloud near the limit keeps recall of 0.97 and more."""
    monkeypatch.setattr(embed, "SUB_BLOCK", 16)
    small = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(60, 32))
    cloud = np.concatenate([centre + rng.normal(size=centre.shape) * s for s in (0.0, 0.1, 0.18, 0.22, 0.24)])
    plant = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(cloud)], "vec_id long, embedding array<double>")
    for df, exact in ((odd_vectors, True), (small, True), (plant, False)):
        rows = [(r.vec_id, r.embedding) for r in df.collect()]
        want, got = brute_links(rows, 0.95), [tuple(r) for r in embed.near_duplicates(df).collect()]
        if exact:
            assert Counter(got) == Counter(want)
        else:
            links = {w[0]: w[1] for w in want}
            assert all(g[1] <= links[g[0]] for g in got)
            assert sum(g[1] for g in got) >= 0.97 * sum(links.values()) > 100
    assert embed.near_duplicates(odd_vectors.limit(0)).count() == 0


def test_recall_holds_for_long_keys(monkeypatch, spark):
    """With keys as long as those of a large table, pairs above the limit are still found."""
    monkeypatch.setattr(embed, "BUCKET", 1)
    rng = np.random.default_rng(12)
    centre = rng.normal(size=(800, 64))
    twin = centre + rng.normal(size=centre.shape) * 0.2
    x = np.concatenate([centre, twin])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {i for i in range(800) if u[i] @ u[i + 800] >= 0.95}
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id for r in embed.near_duplicates(df).where("n_links > 0 and vec_id < 800").collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 300


@pytest.mark.parametrize("common", [0.7, 0.94])
def test_recall_holds_with_a_common_mean(monkeypatch, spark, common):
    """Vectors that share most of their length, pairs right at the limit, keys as long as those of a large table."""
    monkeypatch.setattr(embed, "BUCKET", 1 if common < 0.9 else 64)
    rng = np.random.default_rng(13)
    n, dims, cos = 1500, 64, 0.9501
    inner = (cos - common) / (1 - common)
    g = rng.normal(size=(n, dims - 1))
    g /= np.linalg.norm(g, axis=1)[:, None]
    h = rng.normal(size=g.shape)
    h -= (h * g).sum(1)[:, None] * g
    h = inner * g + np.sqrt(1 - inner * inner) * h / np.linalg.norm(h, axis=1)[:, None]
    x = np.concatenate([np.full((2 * n, 1), np.sqrt(common)), np.sqrt(1 - common) * np.concatenate([g, h])], axis=1)
    assert ((x[:n] * x[n:]).sum(1) >= 0.95).all()
    near = x @ x.T >= 0.95
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed.near_duplicates(df).collect()}
    assert all(got[i] <= near[i].sum() - 1 for i in got)
    assert sum(got.values()) >= 0.97 * (near.sum() - 2 * n) >= 0.97 * 2 * n


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style></head><body>{body}</body></html>"


NAV = '<nav><ul><li><a href="/x">Home page</a></li><li>About us</li></ul></nav>'
PAGES = [
    (page(f'{NAV}<div class="ad">Buy now</div><article><h1>Title &amp; more&nbsp;here</h1><p><b>Lead<br><p>Second  \n para &lt;x&gt;.</p></article><footer>&copy; us</footer>'),
     "Title & more here\nLead\nSecond para <x>."),
    (page('<main><header>Site</header><p>One<script>var t="</p>";</script> two</p><aside>Side</aside><form><p>Mail</p></form><ul><li>a</li><li>b</li></ul>'
          '<div class="comments"><div><p>First!</p></div></div><p>End</p></main><p>after</p>'), "One two\na\nb\nEnd\nafter"),
    (page('<article><div id="cookie-notice"><p>We use cookies</p></div><div class="body"><p>Text &am &amp</p></div><p hidden>no</p><p class="share-bar">Share</p><p>x<!-- c --> y'),
     "Text &am &\nx y"),
    (page("<article><table><tr><td>1</td><td>2</td></tr></table><pre>a\n  b</pre></article>"), "1 2\na b"),
    ("", ""), (None, ""), ("plain text & no tags", "plain text & no tags"), ("<article>open <b>bold", "open bold"), ("<p>unclosed <script>x", "unclosed"),
    ("<article><p>" + "long " * 50_000 + "</p></article>", ("long " * 50_000).strip()),
]


def test_blocks_and_extract(spark):
    rows = [(i, f"http://h{i}.example/a", h, "clash") for i, (h, _) in enumerate(PAGES)] + [(77, None, PAGES[0][0], "clash"), (77, None, PAGES[0][0], "clash"), (None, "::bad[", PAGES[0][0], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = html.extract(df).collect()
    assert len(out) == len(rows)
    for r in out:
        want = PAGES[r.page_id][1] if r.page_id is not None and r.page_id < 70 else PAGES[0][1]
        assert r.text == want and r.n_chars == len(want)
    assert html.extract(df.limit(0)).count() == 0


def test_repeated_runs_of_a_host_go_and_unique_runs_stay(spark):
    """Pages without an article: brute force over all substrings of 20 and more tokens shared by two pages of the host."""
    least = 20
    import random
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    shared = [" ".join(word() for _ in range(n)) for n in (3, 9, 19, 20, 33)]
    pages = []
    for i in range(12):
        parts = [" ".join(word() for _ in range(rnd.randint(2, 12))) for _ in range(4)] + rnd.sample(shared, 2)
        rnd.shuffle(parts)
        pages.append((i, f"http://{'ab'[i % 2]}.example/{i}", "".join(f"<div><p>{p}</p></div>" for p in parts), parts))
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    for i, _, _, parts in pages:
        stream = [w for p in parts for w in p.split()]
        others = [" " + " ".join(w for p in o[3] for w in p.split()) + " " for o in pages if o[0] != i and o[0] % 2 == i % 2]
        gone = set()
        for s in range(len(stream) - least + 1):
            if any(f" {' '.join(stream[s:s + least])} " in o for o in others):
                gone |= set(range(s, s + least))
        want, at = [], 0
        for p in parts:
            left = [w for k, w in enumerate(p.split()) if at + k not in gone]
            at += len(p.split())
            want += [" ".join(left)] if left else []
        assert got[i] == "\n".join(want)


def test_only_long_repeats_go_and_copies_stay(spark):
    """Shared phrases of 12 words stay, a shared passage of 40 goes, copies of a page (with another menu) keep their text."""
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    phrase, notice = words("phrase", 12), words("notice", 40)
    article = words("article", 90)
    pages = [(i, "http://h.example/a", f"<p>{words(f'x{i}_', 30)} {phrase} {words(f'y{i}_', 30)}</p><p>{notice}</p>") for i in range(3)]
    pages += [(i, f"http://h.example/{i}", f"<nav>{words(f'menu{i}_', 5)}</nav><div><p>{article}</p></div>") for i in (10, 11, None, None)]
    pages += [(None, "http://h.example/n", f"<p>{words(f'null{i}_', 25)}</p><p>{notice}</p>") for i in range(2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = Counter((r.page_id, r.text) for r in html.extract(df).collect())
    want = [(i, f"{words(f'x{i}_', 30)} {phrase} {words(f'y{i}_', 30)}") for i in range(3)]
    want += [(i, article) for i in (10, 11, None, None)] + [(None, words(f"null{i}_", 25)) for i in range(2)]
    assert got == Counter(want)


POST = "A long post. " * 20
FRAMES = [
    # an article inside a wrapper that is chrome by name, by a page-wide form or as an element
    ('<div class="content has-sidebar"><div>Teaser</div><article><p>Text</p></article></div>', "Text"),
    ('<form id="aspnetForm"><div>Menu</div><main><p>Text</p></main></form>', "Text"),
    ('<div class="popup related share header"><article>Text<div class="share">Share</div></article></div>', "Text"),
    ('<div class="page nav-open no-footer"><article>Text</article></div>', "Text"),
    # but not in navigation, footer, comments and what is hidden
    *((f"<article>Text</article>{a}<article>Other</article>{b}", "Text") for a, b in (
        ("<nav>", "</nav>"), ("<footer>", "</footer>"), ('<div class="comment-list">', "</div>"), ('<div id="siteFooter">', "</div>"), ("<div hidden>", "</div>"))),
    # what is open beside an article stays, whichever is larger
    (f'<article>Teaser</article><div class="post-body"><p>{POST}</p></div>', f"Teaser\n{POST.strip()}"),
    (f'<article>{POST}</article><div>It goes on</div>', f"{POST.strip()}\nIt goes on"),
    # all of an untagged page inside a wrapper
    ('<nav>Home</nav><form><div class="post"><p>One</p><p>Two</p></div></form><footer>End</footer>', "One\nTwo"),
    ("<nav>Home</nav><footer>End</footer>", ""),
    # a head without its end tag
    ("<html><head><title>t</title><meta charset=utf-8><style>p{}</style><body><article>Text</article>", "Text"),
    ("<html><head><title>t</title><p>Text", "Text"),
]


def test_no_article_is_lost_to_its_frame(spark):
    df = spark.createDataFrame([(i, f"http://f{i}.example/", h) for i, (h, _) in enumerate(FRAMES)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert [got[i] for i in range(len(FRAMES))] == [t for _, t in FRAMES]


STRAY = [
    ("<article><p>One</p><p>if a < b then the rest of the text", "One\nif a < b then the rest of the text"),
    ("<p>price < 5 euro and more", "price < 5 euro and more"),
    ("<p>5 <6 and 7> 3, x<=y <- z</p>", "5 <6 and 7> 3, x<=y <- z"),
    ('<p>a <b c="d > e < f">bold</b> x</p>tail <i unclosed', "a bold x\ntail <i unclosed"),
    ('<p title="x<y" data=\'a>b\'>t</p>', "t"),
    ('<div title="foo> text <b>bold</b> more</div> x', "text bold more\nx"),
    ("<p class=it's>Hello, it's me</p>", "Hello, it's me"),
    ("one <svg>two<p>three", "one two\nthree"), ("one <svg/>two", "one two"), ("one <svg>gone</svg>two", "one two"),
    ("<div><p>x <a <a <p>y", "x <a <a\ny"), ("x <! y", "x <! y"), ("x <!-- y", "x"), ("<script>a</script >b<script>c", "b"),
]


@pytest.mark.parametrize("source,text", STRAY)
def test_stray_signs_lose_no_text(source, text):
    assert "\n".join(t for _, t in html.blocks(source)) == text


@pytest.mark.parametrize("unit", ["<a ", '<a "', '<a "="', "<a '\">", '<a="', '<a ">" ', '<a =">" ', "<svg>", '<div ="<"', "</div>", "<div><p>", "<!", "<?", "<!--", "<title>", "&lt", "<b=\"'<b='\""])
@pytest.mark.parametrize("tail", ["", ">", '">'])
def test_a_page_is_read_in_linear_time(unit, tail):
    """A megabyte of unclosed tags and quotes takes seconds, not hours."""
    import time
    begin = time.process_time()
    html.blocks(unit * (1_000_000 // len(unit)) + tail)
    assert time.process_time() - begin < 20


def test_the_host_decides_beside_an_article(spark):
    """Text that goes on outside its article stays; a notice that other articles of the host have too goes."""
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    notice = words("notice", 25)
    rows = [(i, f"http://h.example/{i}", f"<article><p>{words(f'a{i}_', 40)}</p></article><div>{words(f'more{i}_', 30)}</div><div>{notice}</div>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {i: f"{words(f'a{i}_', 40)}\n{words(f'more{i}_', 30)}" for i in range(4)}


def test_articles_of_the_test_pages(spark):
    """Every article is what a plain reading of the fixture's fixed frame gives."""
    import html as entities
    import re
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", body)
        want = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts]
        assert "\n".join(t for _, t in html.blocks(r.html) if _ == html.MAIN) == "\n".join(w for w in want if w)


def brute_chats(rows):
    convs = defaultdict(set)
    for c, turn, role, text in rows:  # a turn without an id is a conversation of its own
        convs[c if c is not None else (turn, role, text)].add((turn, role, text))
    none_first = lambda x: (x is not None, x if x is not None else "")
    order = {c: [t[1:] for t in sorted(v, key=lambda t: tuple(map(none_first, t)))] for c, v in convs.items()}
    out = []
    for c, turns in order.items():
        if any(len(o) > len(turns) and o[:len(turns)] == turns for o in order.values()):
            continue
        same = [k for k, o in order.items() if o == turns]
        known = [k for k in same if not isinstance(k, tuple)]
        if c == (min(known) if known else same[0]):
            text = "".join(f"<|{r if r is not None else 'unknown'}|>\n{t if t is not None else ''}\n" for r, t in turns)
            out.append((None if isinstance(c, tuple) else c, len(turns), len(same), text))
    return Counter(out)


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"),
    (3, 0, "user", "hi"), (4, 5, "user", "hi"), (4, 9, "assistant", "yo"), (4, 11, "user", "more"), (5, 0, "user", None), (5, 1, None, ""),
    (6, 0, "user", ""), (6, 1, None, ""), (7, 0, "user", None), (8, 0, "user", "dup"), (8, 0, "user", "dup"), (8, 1, "assistant", "a"), (9, 0, "user", "dup"),
    (10, 0, "user", "t1"), (10, 0, "user", "t0"), (None, 0, "user", "lost"), (None, None, None, None), (None, 3, "user", "lost"), (None, 3, "user", "lost"), (None, 1, "user", "hi"), (None, 0, "assistant", "end"), (11, 0, "assistant", "hi"), (12, 0, "user", "x" * 200_000),
    (13, 0, "unknown", ""),
]


def test_chats_equal_brute_force(spark):
    df = spark.createDataFrame([(*r, "clash") for r in CHATS], "conv_id long, turn long, role string, text string, _pos string")
    assert Counter(map(tuple, chat.render(df).collect())) == brute_chats(CHATS)
    real = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in real.select("conv_id", "turn", "role", "text").collect()]
    cut = [(c + 10_000, t, r, x) for c, t, r, x in rows if t < 2]
    both = spark.createDataFrame(rows + cut, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, chat.render(both).collect())) == brute_chats(rows + cut)
    assert chat.render(df.limit(0)).count() == 0


def test_a_third_of_the_turns_without_an_id(spark):
    """They are conversations of their own, no group that one task would hold."""
    rows = [(None if i % 3 == 0 else i // 10, i % 10, "user" if i % 2 else "assistant", f"turn {i % 77}") for i in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, chat.render(df).collect())) == brute_chats(rows)


def test_chat_sql_agrees(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", CHATS)
    assert Counter(con.execute(ORACLE["op10_chat"]).fetchall()) == brute_chats(CHATS)


def test_the_rotation_is_learned_with_one_vector_at_the_mean(spark, monkeypatch):
    """A vector near the mean may change the plan, never the method: the codes come from a fitted rotation, and near pairs are found."""
    fitted = []
    learn = embed.itq
    monkeypatch.setattr(embed, "itq", lambda x, rng: fitted.append(len(x)) or learn(x, rng))
    rng = np.random.default_rng(21)
    common = np.full(32, 0.6)
    base = common + rng.normal(size=(500, 32)) * 0.5
    twin = base + rng.normal(size=base.shape) * 0.08
    x = np.concatenate([base, twin, base.mean(0)[None, :]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed.near_duplicates(df).collect()}
    assert fitted and min(fitted) == len(x)
    assert all(got[i] <= near[i] for i in got) and sum(got.values()) >= 0.97 * near.sum() > 500
