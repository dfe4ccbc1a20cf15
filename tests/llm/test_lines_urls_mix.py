from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from common import corpus, documents, empty

from rooftide.llm import line_dedup, source_mix, url_filter
from rooftide.llm._common import NO_ID

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    first = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), NO_ID), NO_ID if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] >= (NO_ID if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize(("hot", "broadcast"), [(False, 0), (True, 0), (True, 1000)])
def test_line_dedup_matches_brute_force(spark, hot, broadcast, monkeypatch):
    rng = random.Random(4)
    pool = ["Shared Line number %d" % i for i in range(9)] + ["short", "ÉCOLE shared line", "école shared line", "  shared line NUMBER 3\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6)))) for i in range(80)]
    rows += [rows[3], (None, pool[0] + "\nonly here at the end"), (90, None), (91, ""), (92, "\n\n" + pool[1] + "\n")]
    if hot:
        rows += [(100 + i, "one very common line of all") for i in range(120)]
        monkeypatch.setattr(line_dedup, "HOT_LINES", 20)
        monkeypatch.setattr(line_dedup, "HOT_LEAST", 5)
        monkeypatch.setattr(line_dedup, "BROADCAST_HOT", broadcast)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS n_lines", "1 AS dropped", "2 AS first")
    got = line_dedup.drop_repeated_lines(df)
    assert {"kept_text", "n_lines", "n_dropped", "dropped", "first"} <= set(got.columns)
    assert Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(rows)


def test_line_bitmaps_are_runs(spark):
    df = spark.createDataFrame([(1, "same line here\nx"), (2, "x\nsame line here\nsame line here\ny\nsame line here")], "doc_id long, text string")
    (row,) = line_dedup.line_keep_bitmaps(df).collect()
    assert row.dropped == [1, 2, 4] and [(r.first, r.last) for r in row.dropped_runs] == [(1, 2), (4, 4)]
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def test_corpus_lines(spark):
    rows = [(r[0], r[1]) for r in corpus()]
    got = line_dedup.drop_repeated_lines(documents(spark)).collect()
    assert Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got) == brute_lines(rows)


URLS = [
    "http://a.example.net/en/x", "https://NET/", "net://net", "http://net", "x", "", None, "http://example.com/de/1?q=http://net/",
    "http://sub.example.com/DE/", "http://my.org/fr/", "http://norg/fr/", "http://a.net#/en/", "http://example.net:80/en/", "ftp://my-pills.example.com/",
    "http://pillsbury.example.com/", "http://a.com/best/casino", "http://a.com/?casino", "http://x\ny.net/a\nb",
]


def brute_url(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate(LOWER), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if fits:
        best = max(fits, key=lambda r: len(r[0] + r[1]))
        return host, path, best[0] + best[1], best[2]
    tokens = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in host + path).split()
    return host, path, None, "block" if set(tokens) & set(url_filter.UNWANTED) else "allow"


def test_url_filter_matches_brute_force(spark):
    rows = [(i % 7, u, "h") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.judge_urls(df)
    assert Counter(map(tuple, got.collect())) == Counter((i, *brute_url(u)) for i, u, _ in rows)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_rule_without_literal_and_without_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    any_rule = url_filter.Rule("^[^/]+/", "block", "any", 1, ())
    assert url_filter.judge_urls(df, [any_rule]).first().verdict == "block"
    assert url_filter.judge_urls(df, []).first().verdict == "allow"


ODD_URLS = ["http://a.com/Xspam", "http://a.com/SPAM", "http://a.com/xspam", "http://a.com/spamX", "HTTP://A.COM/éspamé", "http://spamÉ.com/", "http://x.com/日本casino/", "http://x.com/Poker9", "http://PORN.x/"]


@pytest.mark.parametrize("most", [20_000, 100])
def test_index_finds_what_trying_all_rules_finds(spark, monkeypatch, most):
    """Thousands of rules of both kinds, hosts and words in all scripts and cases; broadcast and joined."""
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
    rng = random.Random(6)
    names = ["".join(rng.choice("abcé9-X") for _ in range(rng.randrange(1, 5))) for _ in range(1700)]
    hosts = [n.translate(LOWER).strip("-") or "q" for n in names]
    rules = [url_filter.site_rule(rng.choice(["block", "allow"]), f"{rng.choice(hosts)}.{rng.choice(['com', 'net'])}", rng.choice(["", "/", "/En/", f"/{rng.choice(names)}", f"/{rng.choice(names)}/"])) for _ in range(3500)]
    rules += [url_filter.word_rule("block", n) for n in names[:1500]] + [url_filter.Rule("\\?$", "block", "never", 1, ())]
    urls = ODD_URLS + [f"http://{'www.' if rng.random() < 0.3 else ''}{rng.choice(hosts)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice([*names, 'En', 'EN'])}/{rng.choice(names)}" for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = url_filter.rules_frame(spark, rules)
    assert table.count() == len(rules) == 5001
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(df, rules if most > 100 else table).collect()}
    for i, url in enumerate(urls):
        host, path = brute_url(url)[:2]
        fits = [(r.label is not None, r.weight, -k, r) for k, r in enumerate(rules) if re.search(r.pattern, host + path)]
        best = max(fits, key=lambda x: x[:3])[3] if fits else None
        assert got[i] == ((best.label, best.verdict) if best else (None, "allow")), url
    assert sum(v == "block" for _, v in got.values()) > 50


def test_default_words_in_any_surroundings(spark):
    df = spark.createDataFrame(list(enumerate(ODD_URLS)), "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(df).collect()} == {i: brute_url(u)[3] for i, u in enumerate(ODD_URLS)}


def test_a_url_in_most_rows(spark):
    rows = [(i, "http://a.net/x" if i % 3 else f"http://b.org/{i}") for i in range(600)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_url(u)) for i, u in rows)


def water_fill(sizes, weights, share, most):
    left, total = dict(sizes), Fraction(share) * sum(sizes.values())
    out = {}
    while left:
        level = total / sum(weights[s] for s in left)
        full = [s for s in left if level * weights[s] > most * left[s]]
        if not full:
            return out | {s: level * weights[s] for s in left}
        for s in full:
            out[s] = Fraction(most * left.pop(s))
            total -= out[s]
    return out


def test_mix_targets_copies_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "RANK_ROWS", 7)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 50), rng.choice(["é", "a", "b", "B", None, "zz"])) for i in range(400)]
    rows += [rows[0], rows[0], (None, "x y", "a"), (500, None, "a"), *[(600 + i, "same size here", "a") for i in range(100)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'s' AS src", "0 AS size", "1 AS rank")
    got = source_mix.mix_sources(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mix_sources(df.repartition(5)).collect()))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes["" if source is None else "=" + source] += len((text or "").split())
    order = sorted((s for s in sizes if s), key=lambda s: s.encode()) + [""]
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, Fraction(3, 2), 2)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.src] and r.target == pytest.approx(float(want[r.src])) and 0 <= r.copies <= 2
        taken[r.src] += r.copies * r.size
    for s, target in want.items():
        assert abs(taken[s] - target) <= 50
    assert source_mix.mix_sources(empty(spark)).count() == 0
    assert source_mix.mix_sources(df.where("doc_id = 500")).first().copies == 0


@pytest.mark.parametrize("ids", ["outlier", "one", "null"])
def test_ranks_of_any_ids(spark, monkeypatch, ids):
    """One outlying id, one id for all rows, no ids: every source's copies are those of its rows in order."""
    monkeypatch.setattr(source_mix, "RANK_ROWS", 20)
    rng = random.Random(5)
    own = {"outlier": lambda i: i if i else 2**62, "one": lambda i: 5, "null": lambda i: None}[ids]
    rows = [(own(i), " ".join(["w"] * rng.choice([0, 0, 3, 9])) + f" t{i}", "ab"[i % 4 == 0]) for i in range(300)]
    got = source_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "text AS carried"), carry=("carried",)).collect()
    assert Counter((r.carried, r.src) for r in got) == Counter((t, "=" + s) for _, t, s in rows)
    for src in ("=a", "=b"):
        part = [r for r in got if r.src == src]
        rate = part[0].target / part[0].source_size
        for upto in sorted({r.size for r in part}):
            first = [r for r in part if r.size <= upto]
            assert abs(sum(r.copies for r in first) - rate * len(first)) <= 1  # systematic: a prefix gets its share
        assert len({(r.target, r.source_size) for r in part}) == 1


def test_many_sources_are_weighed_in_order(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "RANK_ROWS", 10)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 60), f"s{rng.randrange(10**6):06d}") for i in range(150)]
    got = source_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes["=" + source] += len(text.split())
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}, Fraction(3, 2), 2)
    assert all(r.target == pytest.approx(float(want[r.src])) for r in got)


def test_mix_corpus(spark):
    got = source_mix.mix_sources(documents(spark)).collect()
    assert Counter((r.doc_id, r.src, r.size) for r in got) == Counter((r[0], "" if r[3] is None else "=" + r[3], len((r[1] or "").split())) for r in corpus())
    by_source = defaultdict(list)
    for r in got:
        by_source[r.src].append(r)
    for part in by_source.values():
        rate = part[0].target / part[0].source_size
        assert abs(sum(r.copies for r in part) - rate * len(part)) <= 1
