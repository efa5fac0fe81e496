"""Line deduplication, URL filters, mixing and decontamination on small tables with odd rows."""

import hashlib
import math
import random
import re

import duckdb
import pytest

from tidalframe.llm.decontamination import contamination, decontaminate
from tidalframe.llm.line_dedup import line_dedup
from tidalframe.llm.mixing import mix_sources
from tidalframe.llm.queries import QUERIES
from tidalframe.llm.url_filter import ORACLE as url_filter_sql
from tidalframe.llm.url_filter import HostRule, PatternRule, url_filter

SMALL = "/root/testdata/sf0.001"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def chunks(text):
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        if i == 0 or int(md5(md5(lines[i - 1]) + md5(line))[:6], 16) % 3 == 0:
            out.append([])
        out[-1].append(line)
    return out


def test_lines(spark):
    rng = random.Random(1)
    pool = [f"line {k}" for k in range(12)]
    passage = "\n".join(f"shared line number {k}" for k in range(12))
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 40)))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "own start\n" + passage + "\nown end"), (104, passage), (105, "x\n" + passage), (5, rows[4][1]), (7, rows[7][1]), (200, "long line " * 20000 + "\n" + passage)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'a' AS chunk", "1 AS pos", "2 AS n_lines")
    out = line_dedup(df)
    assert out.columns == [*df.columns, "n_removed"]
    first = {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for pos, c in enumerate(chunks(t)):
            if len(c) > 1:
                place = (i, md5(t), pos)
                first.setdefault(tuple(c), set()).add(place)
    # rows of equal id and text are one document; two different texts of one id are told apart by a hash of the text
    want = []
    for i, t in rows:
        if t is None:
            want.append((i, None, 0, 0))
            continue
        kept = [c for pos, c in enumerate(chunks(t)) if len(c) < 2 or (i, pos) == min((a, p) for a, _, p in first[tuple(c)])]
        want.append((i, "\n".join("\n".join(c) for c in kept), t.count("\n") + 1, t.count("\n") + 1 - sum(map(len, kept))))
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()]
    twin = lambda rows: sorted((r for r in rows if r[0] != 5), key=repr)
    assert twin(got) == twin(want)
    assert sum(r[3] for r in got if r[0] == 103) > 0 or sum(r[3] for r in got if r[0] == 104) > 0
    assert line_dedup(df.where("false")).count() == 0


def test_urls(spark):
    rows = [
        (1, "https://a.example.net/en/1"), (2, "http://example.net/de/1"), (3, "http://EXAMPLE.com/de/"), (4, "http://x.org/fr/a"), (5, "http://x.org/FR/a"), (6, None), (7, ""), (8, "no scheme.net/"),
        (9, "http://x.net"), (10, "http://x.net?q"), (11, "http://notexample.com/de/"), (12, "http://spam-farm.example.org/en"), (21, "http://x.org/spam-farm"), (22, "http://x.org/a/spam-farm?b"), (13, "http://myspam-farm.example.org/en"), (14, "http://a.org/x?u=spam-farm"),
        (15, "http://net/"), (16, "http://x.org/?sessionid=0123456789abcdef00"), (17, "x" * 50000 + "://a.net/" + "y" * 50000), (18, "http://a.net:80/"), (19, "http://fr.org/fr/://b.net/"), (20, "HTTP://A.Net/#f"), (None, "http://b.net/"), (20, "HTTP://A.Net/#f"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'h' AS host", "'t' AS token", "1 AS rule_id")
    out = url_filter(df)
    assert out.columns == ["page_id", "url", "token", "rule_id", "host", "path", "rule", "verdict"]

    def judge(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, a) for a, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        bad = re.search(r"://[^?#]*(?<![a-z0-9])spam-farm(?![a-z0-9])|[?&]sessionid=[0-9a-f]{16,}", (url or "").lower())
        return host, path, None, "block" if bad else "allow"

    got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {(i, u): judge(u) for i, u in rows} and out.count() == len(rows)
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", [list(r) for r in rows])
    names = [c[0] for c in db.execute(url_filter_sql).description]
    assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in (dict(zip(names, x)) for x in db.execute(url_filter_sql).fetchall())} == {(i, *judge(u)) for i, u in rows}
    assert url_filter(df.where("false")).count() == 0
    custom = url_filter(df, host_rules=[HostRule("block", "x.org", "/f")], pattern_rules=[PatternRule("allow", "any", "x", ("x",))])
    assert {r.page_id for r in custom.where("verdict = 'block'").collect()} == {4}
    with pytest.raises(ValueError):
        url_filter(df, host_rules=[], pattern_rules=[PatternRule("block", "all", ".", ())])


def plain_quantile(i, rate):
    u, k, p, c = int(md5(f"17:{i}")[:13], 16) / 2**52, 0, math.exp(-rate), math.exp(-rate)
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_mixing(spark):
    rows = [(i, "big" if i % 3 else "small", f"t{i}") for i in range(6000)] + [(None, None, None), (7, None, ""), (7, None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "'c' AS copy", "1 AS rate", "2 AS _salted")
    out = mix_sources(df, weights={"big": 1.0, "small": 3.0}, total_rows=8000)
    assert out.columns == ["doc_id", "source", "text", "rate", "_salted", "copy", "mix_key"]
    got = out.collect()
    n = {s: sum(r.source == s for r in got) for s in ("big", "small", None)}
    assert abs(n["big"] - 2000) < 250 and abs(n["small"] - 6000) < 400 and n[None] == 0
    rates = {"big": 2000 / 4000, "small": 6000 / 2000}

    assert sorted((r.doc_id, r.copy) for r in got) == sorted((i, c + 1) for i, s, _ in rows if s for c in range(plain_quantile(i, rates[s])))
    assert 0 < sum(a.doc_id > b.doc_id for a, b in zip(got, got[1:])) < len(got)
    equal = mix_sources(df).groupBy("source").count().collect()
    assert {r["source"] for r in equal} >= {"big", "small"}
    big = mix_sources(df.where("source = 'small'"), total_rows=2_000_000).groupBy("doc_id").count().agg({"count": "avg"}).first()[0]
    assert abs(big - 1000) < 5
    assert mix_sources(df.where("false")).count() == 0


ITEM = "Mary Jones bought 12 apples at 3 dollars each and gave 12 of them to her friend Bob before the long walk home through the park"


def test_decontamination(spark):
    pad = "some other words stand here in front. " * 30
    rows = [
        (1, pad + ITEM + ". " + pad), (2, pad + ITEM.replace("12", "40").replace("3", "7").replace("Mary Jones", "Anna").replace("Bob", "Tim Smith") + " " + pad),
        (3, ITEM.replace("12", "40", 1)), (4, pad), (5, None), (6, ""), (7, " ".join(reversed(ITEM.split()))), (8, "tiny item 5 km"), (9, ITEM.upper()), (10, ITEM * 1000), (10, pad), (None, ITEM), (11, "5 6 7 8 9 10 11 12 13 14 15 16"),
        (12, " ".join(ITEM.split()[:8])), (13, "Über " + " ".join(ITEM.split()[6:])),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS id", "1 AS hash", "2 AS item_id")
    bench = spark.createDataFrame([(1, ITEM), (2, "Tiny item 9 km"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8 9 10 11 12")], "item_id bigint, text string").selectExpr("*", "'q' AS id")
    found = {(r.id, r.item_id): r.changed for r in contamination(docs, bench).collect()}
    top = (1 << 63) - 1
    assert found == {(1, 1): False, (2, 1): True, (8, 2): True, (10, 1): False, (top, 1): False, (13, 1): False}
    assert {(r.id, r.item_id): r.changed for r in contamination(docs, bench, broadcast_windows=0).collect()} == found
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 9, 10, 11, 12]
    assert contamination(docs.where("false"), bench).count() == 0 and decontaminate(docs, bench.where("false")).count() == len(rows)


def test_decontamination_finds_copies_of_items_full_of_slots(spark):
    """Items of numbers, names, units or capitals are found word for word, in any case, and not with other values."""
    items = [
        "37 * 12 * 4 / 9 = ?", "Then Anna Bob Carl Dora Emil Fritz Gina Hans Ida Jan Karl Lena", "5 km 7 kg 9 miles 12 litres 3 hours 8 days 40 watts",
        "HOW MANY WHEELS HAVE SEVEN CARS AND NINE BICYCLES TOGETHER IN A ROW", "42 7",
    ]
    pad = "some other words stand here in front of it. " * 20
    rows = [(k, f"{pad} {t} {pad}") for k, t in enumerate(items)] + [(10 + k, f"{pad} {t.lower()} {pad}") for k, t in enumerate(items)]
    rows += [(20, pad + items[0].replace("12", "13")), (22, pad + items[2].replace("7", "6").replace("3", "2")), (23, pad), (24, "42 8 7")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for limit in (0, 1000):
        found = {(r.id, r.item_id): r.changed for r in contamination(docs, bench, broadcast_windows=limit).collect()}
        assert found == {(d + k, k): False for d in (0, 10) for k in range(len(items))}


def test_decontamination_query_finds_what_is_there(spark):
    """Every item that stands in a text word for word, and nothing in texts that share no ten words with one."""
    plain = lambda t: re.sub(r"[^\w ]", "", " ".join((t or "").lower().split()))
    docs = [(r.doc_id, plain(r.text)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_benchmark_decontamination"](spark, SMALL).collect()}
    assert got >= {(d, i) for d, t in docs for i, q in items if f" {q} " in f" {t} "} and got
    grams = {i: {tuple(q.split()[k : k + 6]) for k in range(len(q.split()) - 5)} for i, q in items}
    for d, i in got:
        words = dict(docs)[d].split()
        assert any(tuple(words[k : k + 6]) in grams[i] for k in range(len(words)))


def test_decontamination_of_short_items(spark):
    """Few own words are not enough for other fillings; wording with arithmetic is."""
    pad = "some other words stand here in front of it. " * 5
    items = ["Who is Mary?", "WHAT HAVE SEVEN CARS", "Solve 37 * 12 - 4 = ?"]
    rows = [
        (1, pad + "He asked who is Peter and left " + pad), (2, pad + "What Anna said was 7 times as good " + pad), (3, pad + "Solve 41 * 9 - 7 = ? " + pad), (4, pad + "Solve 41 / 9 - 7 = ? " + pad),
        (5, pad + "He asked who is Mary and left " + pad), (6, pad + "what have seven cars " + pad), (7, pad + "Solve 37 * 12 - 4 = ? " + pad), (8, "Solve it"), (9, "* / = ?"), (10, pad + "Solve 5 * 5 - 5 = ?"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {(r.id, r.item_id): r.changed for r in contamination(docs, bench).collect()}
    assert found == {(3, 2): True, (5, 0): False, (6, 1): False, (7, 2): False, (10, 2): True}
    assert sorted(r.doc_id for r in decontaminate(docs, bench).collect()) == [1, 2, 4, 8, 9]


def plain_template(text):
    """Tokens of a text of lower-case words, numbers and names in one sentence, and the filling of each."""
    out = []
    for w in text.split():
        kind = "<number>" if w.isdigit() else "<name>" if w[0].isupper() else w
        if kind == "<name>" and out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + " " + w.lower())
        else:
            out.append((kind, w.lower()))
    return out


def plain_windows(tokens, length, least):
    for i in range(len(tokens) - length + 1):
        w = tokens[i : i + length]
        own = sum(not k.startswith("<") for k, _ in w)
        if own >= (2 if len(tokens) == length else least) and own:
            yield i, tuple(k for k, _ in w), [v for k, v in w if k.startswith("<")]


def plain_found(text, item):
    """By all pairs of windows: None, or whether a filling differs; items with a window full of slots are also looked for word by word."""
    results = []
    a, b = plain_template(item), plain_template(text)
    words, other = [(w.lower(), "") for w in item.split()], [(w.lower(), "") for w in text.split()]
    full = any(sum(own(x) for x in w[i : i + 10]) < min(5, len(w)) for w, own in ((a, lambda x: x[0][0] != "<"), (item.split(), str.islower)) for i in range(max(1, len(w) - 9)))
    for mine, theirs, least in ((a, b, 4), (words, other, 0))[: 1 + full]:
        size = min(10, len(mine))
        own = list(plain_windows(mine, size, least))
        lines = {}
        for i, t, was in own:
            for j, u, now in plain_windows(theirs, size, least):
                if t == u:
                    lines.setdefault(j - i, []).append((i, list(zip(was, now))))
        for hits in lines.values():
            filled = {x for _, f in hits for x in f}
            if len({w for w, _ in filled}) == len(filled) and len({i for i, _ in hits}) >= min(6, -(-len(own) // 2)):
                results.append(any(w != n for w, n in filled))
    return min(results) if results else None


def test_decontamination_equals_brute_force(spark):
    import random

    draw = random.Random(5)

    def text(n):
        kinds = [draw.choice(["w", "w", "w", "n", "C"]) for _ in range(n)]
        return "start " + " ".join({"w": draw.choice(["apple", "river", "stone", "wind"]), "n": str(draw.randrange(3)), "C": draw.choice(["Anna", "Bert"])}[k] for k in kinds)

    items = [text(draw.choice([2, 3, 5, 9, 12, 18])) for _ in range(24)]

    def altered(item):
        new = {x: draw.choice(["0", "1", "7"]) for x in "012"} | {"Anna": draw.choice(["Anna", "Carl"])}
        return " ".join(new.get(w, w) if draw.random() < 0.97 else "other" for w in item.split())

    docs = [text(6).lower() + " " + altered(draw.choice(items)) + " " + text(6).lower() for _ in range(150)] + items[:6] + [altered(i) for i in items[:6]]
    found = contamination(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"))
    got = {(r.id, r.item_id): r.changed for r in found.collect()}
    want = {(d, i): c for d, t in enumerate(docs) for i, q in enumerate(items) if (c := plain_found(t, q)) is not None}
    assert len(want) > 60 and sum(want.values()) > 20
    assert got == want
