import random

import numpy as np

from recollect.llm.arrow_text import mix64
from recollect.llm.templates import Page, Template, _increasing, deduce, extract, keys, slots_of

from .conftest import prose

SCHEMA = "page_id long, url string, html string, host string, part int, tokens string"


def page(rng, host, items, extra=True):
    rows = "".join(f"<li><b>Item:</b> {prose(rng, 3)}</li>" for _ in range(items))
    note = "<aside class=x><i>Seen also elsewhere today</i></aside>" if extra else ""
    body = " ".join(prose(rng, 12) for _ in range(rng.randint(1, 6)))
    return f"<!DOCTYPE html><html><head><title>{host} Daily Bulletin - {body[:20]}</title><style>p{{}}</style><script>var a='<p>';</script></head><body><div id=top>Welcome dear reader of {host}</div><ul>{rows}</ul>{note}<p>{body}</p><div>Copyright reserved forever {host}</div></body></html>", body


def site(rng, n, host="one.example"):
    return [(i, f"http://{host}/{i}", *page(rng, host, rng.randint(1, 5), i % 2 == 0)) for i in range(n)]


def naive_template(pages):
    """Root tokens by explicit occurrence vectors: once on every page, in one order."""
    pages = [p.tolist() for p in pages]
    once = [t for t in set(pages[0]) if all(p.count(t) == 1 for p in pages)]
    return {t for t in once if all((p.index(t) > p.index(u)) == (pages[0].index(t) > pages[0].index(u)) for p in pages for u in once)}


def test_template_and_slots(spark):
    rng = random.Random(1)
    rows = site(rng, 40)
    got = {r["page_id"]: r for r in extract(spark.createDataFrame([(i, u, h, None, 1, None) for i, u, h, _ in rows], SCHEMA)).collect()}
    for i, _, h, body in rows:
        slots = {s["path"]: s["text"] for s in got[i]["slots"]}
        assert slots["html/body/p"] == " ".join(body.split())
        text = got[i]["text"]
        assert not any(w in text for w in ("Welcome", "Copyright", "Bulletin", "Item:", "var a"))
        assert got[i]["host"] == "one.example" and got[i]["template_tokens"] > 20
        assert [s["text"] for s in got[i]["slots"] if s["path"] == "html/body/ul/li"]


def naive_classes(pages):
    """Valid classes of every kind by explicit vectors: sets of tokens with one vector, in one order, each pair apart or one in one gap of the other."""
    pages = [p.tolist() for p in pages]
    vectors = {}
    for t in {t for p in pages for t in p}:
        v = tuple(p.count(t) for p in pages)
        if sum(c > 0 for c in v) >= 0.5 * len(pages):
            vectors.setdefault(v, []).append(t)
    out = []
    for v, group in vectors.items():
        if len(group) < 3:
            continue
        order = sorted(group, key=lambda t: pages[next(i for i, c in enumerate(v) if c)].index(t))
        rows = [[[k for k, x in enumerate(p) if x == t] for t in order] for p in pages]
        flat = [[r[c][k] for k in range(len(r[0])) for c in range(len(order))] for r in rows]
        if all(f == sorted(f) for f in flat):
            out.append((order, flat, v))
    return out


def nested(inner, outer):
    """Gaps of the outer class, taken round, in which the inner one's occurrences lie; None: it holds tokens of the outer between its own."""
    gaps = set()
    for f, g in zip(inner[1], outer[1]):
        k = len(inner[0])
        for s in range(0, len(f), k):
            at = {sum(x < y for x in g) for y in f[s : s + k]}
            if len(at) > 1:
                return None
            gaps.add(at.pop() % len(outer[0]))
    return gaps


def shop(rng, n):
    """Sections that repeat, each with a list that repeats, each row with four fixed words: three levels."""
    out = []
    for i in range(n):
        sections = []
        for _ in range(rng.randint(1, 4)):
            rows = "".join(f"<li><i>Item</i> {prose(rng, 2)} <b>costs</b> {rng.randint(1, 99)} <u>euro</u></li>" for _ in range(rng.randint(1, 5)))
            sections.append(f"<section><h2>Aisle</h2> {prose(rng, 2)} <ul><em>Goods</em>{rows}</ul><p>Subtotal</p> {rng.randint(1, 999)} <p>end</p></section>")
        out.append(f"<html><body><h1>Shop of all things</h1>{''.join(sections)}<div>Total is {rng.randint(1, 9999)} today dear customer</div></body></html>")
    return out


def test_classes_and_nesting_against_vectors():
    """Classes within classes within the root: the tokens with a place are those of the naive classes that nest, and places follow the page."""
    rng = random.Random(5)
    for make in (lambda n: [h for _, _, h, _ in site(rng, n)], lambda n: shop(rng, n)):
        for n in (12, 40):
            pages = [keys(Page(h)) for h in make(n)]
            name, _, on, total, place = deduce(pages, mix64(np.arange(1, n + 1, dtype=np.uint64)), 0.5)
            classes = naive_classes(pages)
            good = []
            for c in sorted(classes, key=lambda c: (-sum(x > 0 for x in c[2]), sum(c[2]))):
                if all(len(nested(c, d) or "no") == 1 for d in good):
                    good.append(c)
            assert len(good) >= 3 and len(good) >= len(classes) - 1
            assert set(name[place >= 0].tolist()) == {t for c in good for t in c[0]}
            at = dict(zip(name.tolist(), place.tolist()))
            assert sorted(x for x in at.values() if x >= 0) == list(range(int((place >= 0).sum())))
            for order, _, _ in good:
                assert [at[t] for t in order] == sorted(at[t] for t in order)
            for c in good:  # a class lies between the two tokens of each class around it, in the template as on the pages
                for d in good:
                    g = nested(c, d) if c is not d else None
                    if g and 0 < min(g) < len(d[0]):
                        k = g.pop()
                        assert at[d[0][k - 1]] < min(at[t] for t in c[0]) <= max(at[t] for t in c[0]) < at[d[0][k]]


def test_three_levels(spark):
    rng = random.Random(9)
    rows = [(i, "http://shop.example/", h, None, 1, None) for i, h in enumerate(shop(rng, 30))]
    for r in extract(spark.createDataFrame(rows, SCHEMA)).collect():
        words = set(r["text"].split())
        assert not words & {"Shop", "Aisle", "Goods", "Item", "costs", "euro", "Subtotal", "end", "Total", "today", "customer"}
        h = rows[r["page_id"]][2]
        assert [s["text"] for s in r["slots"] if s["path"] == "html/body/section/ul/li"] == [x.split(" <")[0].strip() if k == 0 else x for li in h.split("<li>")[1:] for k, x in enumerate((li.split("</i> ")[1], li.split("</b> ")[1].split(" <u>")[0]))]


def test_data_that_repeats_a_word_of_the_template(spark):
    """The word at the template's place is template, the other is data, also when it comes first or out of order."""
    rng = random.Random(7)
    said = ["dollars", "today", "is", "Price", "dollars today"] + [f"{x} {y}" for x, y in (prose(rng, 2).split() for _ in range(60))]
    rows = [(i, "http://p.example/", f"<html><body><p>Price is {w} dollars today</p></body></html>", None, 1, None) for i, w in enumerate(said)]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: got[i]["text"] for i in got} == dict(enumerate(said))
    assert {r["template_tokens"] for r in got.values()} == {10}


def test_matching_by_position():
    assert _increasing(np.array([0, 5, 1, 2, 9, 3])).tolist() == [0, 2, 3, 5] and _increasing(np.zeros(0, int)).tolist() == []
    t = Template(np.array([10, 11, 12], np.uint64), np.arange(3), np.ones(3, bool), np.zeros(3, int), np.arange(3), np.full(3, 3))
    page = np.array([10, 11, 12, 10, 10, 11, 99, 12, 10, 12], np.uint64)
    assert t.match(page).tolist() == [True, True, True, False, True, True, False, True, True, True] or t.match(page).tolist() == [True, True, True, True, False, True, False, True, True, True]


def test_groups_of_a_large_host_agree_with_one_group(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, u, h, None, 1, None) for i, u, h, _ in site(rng, 300)], SCHEMA)
    whole = {r["page_id"]: (r["template_tokens"], r["text"]) for r in extract(df).collect()}
    split = {r["page_id"]: (r["template_tokens"], r["text"]) for r in extract(df, group_pages=60).collect()}
    assert whole == split


def test_hosts_are_apart_and_small_hosts_have_no_template(spark):
    rng = random.Random(3)
    rows = site(rng, 12, "a.example") + [(100 + i, u.replace("a.example", "B.example:80"), h, b) for i, u, h, b in site(rng, 12, "b.example")] + [(200, "http://c.example/", "<p>Lonely page</p>", "")]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame([(i, u, h, None, 1, None) for i, u, h, _ in rows], SCHEMA)).collect()}
    assert got[200]["template_tokens"] == 0 and got[200]["text"] == "Lonely page"
    assert got[100]["host"] == "b.example" and "Welcome" not in got[100]["text"] and "Welcome" not in got[0]["text"]


def test_broken_markup():
    p = Page("<p>a<p>b</i></p><br>c < d <a href='x>y'>e</a><unclosed")
    assert [t for t, tag in zip(p.tokens, p.tag) if not tag][:4] == ["a", "b", "c", "<"]
    one = Template(keys(Page("<div>")), np.zeros(1, int), np.zeros(1, bool), *(np.zeros(1, int),) * 3)
    slots, n = slots_of(Page("<div>x &amp; y<script>no</script></div>"), one)
    assert slots == [{"path": "div", "text": "x & y"}] and n == 1
    assert Page("").tokens == [] and slots_of(Page(""), one)[0] == []


def test_edges(spark):
    rng = random.Random(4)
    h = page(rng, "h", 2)[0]
    rows = [(1, "http://h/1", h), (1, "http://h/1", h), (2, "http://h/2", h), (None, "http://h/3", h), (3, None, "<b>x</b>"), (4, "nonsense", ""), (5, "http://h/5", None), (6, "http://h/6", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame([(*r, "clash", 3, "clash") for r in rows], SCHEMA)
    got = extract(df).collect()
    assert sorted((r["page_id"] or 0) for r in got) == [0, 1, 1, 2, 3, 4, 6]
    by = {r["page_id"]: r for r in got}
    assert by[3]["host"] == "" and by[4]["slots"] == [] and len(by[6]["text"]) > 200_000
    assert extract(df.limit(0)).count() == 0


def test_odd_pages_do_not_take_the_template_away(spark):
    """Empty and error pages, and more equal rows than a group holds, in one group and in several."""
    rng = random.Random(6)
    rows = [(i, u, h, None, 1, None) for i, u, h, _ in site(rng, 200)]
    odd = [(900, "http://one.example/e", "", None, 1, None), (901, "http://one.example/f", "<p>error", None, 1, None), (902, "http://one.example/g", "<html><body>Not found</body></html>", None, 1, None)]
    plain = {r["page_id"]: (r["template_tokens"], r["text"]) for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(n > 20 for n, _ in plain.values())
    for size in (2048, 50):
        got = {r["page_id"]: (r["template_tokens"], r["text"]) for r in extract(spark.createDataFrame(rows + odd, SCHEMA), group_pages=size).collect()}
        assert {i: got[i] for i in plain} == plain
        assert got[900] == (0, "") and got[901] == (0, "error") and got[902][1] == "Not found"
    same = [rows[0]] * 120 + rows[:3]
    got = [r["template_tokens"] for r in extract(spark.createDataFrame(same, SCHEMA), group_pages=50).collect()]
    assert len(got) == 123 and min(got) > 20
