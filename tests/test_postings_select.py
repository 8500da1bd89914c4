"""Search over postings against a scan; selectors against hand-made pages and against a walk over a tree."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import filters, postings
from plumbline.sources import select


@pytest.fixture(scope="module")
def names():
    rng = random.Random(3)
    words = ["park", "PARK", "house", "白金", "ザ・スカイ", "ザスカイ", "しろかね", "シロカネ", "ｔｏｗｅｒ", "tower", "a", "east", "サウス-ヒル", "サウスヒル"]
    return [(i % 90, rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))])) for i in range(220)]


TEXTS = ["park", "白金ざすかい", "park　house", "ザスカイ 白金", "しろかね", "tower east", "A", "zzz", "zzz park", "", None, "サウスーヒル", "park park"]


@pytest.mark.parametrize("smart", [False, True])
def test_postings_find_what_a_scan_finds(spark, tmp_path, names, smart):
    postings.build(spark.createDataFrame(names, "id long, name string").repartition(3), str(tmp_path / "p"))
    queries = spark.createDataFrame(list(enumerate(TEXTS)), "q int, text string")
    got = {(r["q"], r["id"]) for r in postings.search(spark, str(tmp_path / "p"), queries, smart).collect()}
    own = {}
    for i, n in names:
        if n:
            own.setdefault(i, []).append(n.lower())
    want = set()
    for q, text in enumerate(TEXTS):
        parts = (text or "").replace("　", " ").split()
        terms = filters.script_terms(parts[0]) if smart and len(parts) == 1 else parts
        want |= {(q, i) for i, ns in own.items() if terms and all(any(v.lower() in n for v in filters.variants(t) for n in ns) for t in terms)}
    assert got == want and len(want) > 30


def test_terms_at_changes_of_script():
    assert filters.script_terms("白金ザスカイ") == ["白金", "ザ", "スカイ"]
    assert filters.script_terms("parkハウス3") == ["park", "ハウス", "3"] and filters.script_terms("ザー") == ["ザー"] and filters.script_terms("・") == ["・"]
    assert {"ザ・スカイ", "ザスカイ", "ざすかい"} <= set(filters.variants("ざすかい"))


PAGE = """<body><div id=main class="list wide"><ul><li class=row><a href="/u/1?x=1&amp;y=2">One <b>house</b></a><td class=price>100</td><li class="row sold"><a href='b/2'>Two</a><span class=price>200</span>
<ul><li>inner<a name=n>no link</a></ul></li></ul></div><p>loose<p class=price>300<br>yen<script>var a="<a href=x>";</script></p></nothing><img src=pic.png><a href="http://o.example/z">Out</a></body>"""


@pytest.mark.parametrize(
    "selector, texts",
    [
        ("li.row > a", ["One house", "Two"]), ("a[href]", ["One house", "Two", "Out"]), ("#main a", ["One house", "Two", "no link"]), ("div.list.wide .price", ["100", "200"]), ("ul ul li", ["innerno link"]),
        ("body > p", ["loose", "300yen"]), ("a[href^=http], b", ["house", "Out"]), ("a[href$='2']", ["One house", "Two"]), ("li.sold a[name]", ["no link"]), ("div > a", []), ("* > b", ["house"]), ("img", [""]), ("a[class]", []), ("a[href*=u]", ["One house"]),
    ],
)
def test_selectors(selector, texts):
    assert [m.text for m in select.Matcher([select.Selector(selector)]).run(PAGE)] == texts


@pytest.mark.parametrize("bad", ["", "a >", "a,,b", "a[", "a:hover"])
def test_bad_selectors(bad):
    with pytest.raises(ValueError):
        select.Selector(bad)


def test_random_trees_against_a_walk():
    """Selectors on well-formed pages, held against a test of every element and its ancestors."""
    rng = random.Random(8)

    def build(depth, path, out):
        tag, cls = rng.choice(["div", "b", "i"]), rng.choice(["x", "y", "x y", ""])
        me = (tag, cls.split(), len(out))
        out.append(path + [me])
        inner = "".join(build(depth - 1, path + [me], out) for _ in range(rng.randint(0, 3))) if depth else ""
        return f'<{tag} class="{cls}" id="n{me[2]}">{inner}</{tag}>'

    def fits(step, e):
        tag, _, cls = step.partition(".")
        return (not tag or tag == e[0]) and (not cls or cls in e[1])

    def met(steps, path):
        (how, last), rest = steps[-1], steps[:-1]
        if not fits(last, path[-1]):
            return False
        if not rest:
            return True
        return any(met(rest, path[:k]) for k in ([len(path) - 1] if how == ">" else range(1, len(path))) if k)

    for _ in range(150):
        out: list = []
        html = build(4, [], out)
        steps = [(rng.choice([" ", ">"]) if k else "", rng.choice(["div", "b", "i"]) * rng.randint(0, 1) + rng.choice(["", ".x", ".y"])) for k in range(rng.randint(1, 3))]
        steps = [(h, s or "div") for h, s in steps]
        got = [int(m.attrs["id"][1:]) for m in select.Matcher([select.Selector("".join(f" {h} {s}" for h, s in steps))]).run(html)]
        assert got == [p[-1][2] for p in out if met(steps, p)]


def test_pages_as_rows(spark):
    df = spark.createDataFrame([(1, "http://h.example/a/b", PAGE), (2, "http://h.example", None), (3, None, "<li class=row>x")], "page_id long, url string, html string")
    rows = select.listed(df, "page_id", "url", "html", "li.row", {"name": ("a[href]", None), "link": ("a[href]", "href"), "price": (".price", None)}).collect()
    assert [tuple(r) for r in sorted(rows, key=lambda r: (r["page_id"], r["place"]))] == [(1, 0, "One house", "http://h.example/u/1?x=1&y=2", "100"), (1, 1, "Two", "http://h.example/a/b/2", "200"), (3, 0, None, None, None)]
    found = select.selected(df, "page_id", "url", "html", {"pic": ("img", "src"), "bold": ("b", None)})
    assert sorted(map(tuple, found.collect())) == [(1, "bold", 0, "house"), (1, "pic", 0, "http://h.example/a/pic.png")]
    assert select.listed(df.limit(0), "page_id", "url", "html", "li", {"t": ("a", None)}).count() == 0 and select.selected(df.where(F.col("page_id") == 2), "page_id", "url", "html", {"t": ("a", None)}).count() == 0
