"""Source divergence, collocations and archives against plain versions, on odd rows and edges."""

import gzip
import hashlib
import re
from collections import Counter, defaultdict

import pytest

from weftgraph.llm import collocations, source_divergence, warc

SCHEMA = "doc_id long, text string, lang string, source string, item string, n int, value int, `a.b` int"


def rows_of(texts):
    return [(i, t, lang, source, "x", 1, 2, 3) for i, (t, lang, source) in enumerate(texts)]


ODD = [
    (None, "en", "a"), ("", "en", "b"), ("one two THREE", None, None), ("One two three", "", ""), ("one  two-three ÉÉ éé", "en", "a"), ("one éé two one", "en", "b"),
    ("one one éé zwei", "en", "c"), ("one éé", "en", "a"), ("only here", "de", "a"), ("...", "fr", "z"), ("one two", "", None), (None, None, None), ("x" * 5000 + " one éé", "en", "c"),
    ("one two three four", "en", "d"), ("one two three four", "en", "d"),
]


def plain_divergence(rows, least_docs, scale, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    groups, docs, own = set(), defaultdict(set), Counter()
    for i, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in terms(text):
            docs[lang, t].add(i)
            own[lang, source, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), d in docs.items() if x == lang and len(d) >= least_docs)
        sources = sorted(s for x, s in groups if x == lang)

        def chances(counts, kept=kept):
            return {t: 1 + scale * (counts[t] + 1) // (sum(counts.values()) + len(kept)) for t in kept}

        counts = {s: {t: own[lang, s, t] for t in kept} for s in sources}
        p = {s: chances(counts[s]) for s in sources}
        q = chances({t: sum(counts[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            strong = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, values in (("pair", pairs), ("term", strong)):
                values.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(values) if part == "pair" or i < top]
    return Counter(out)


@pytest.mark.parametrize("held", [source_divergence.HELD_ROWS, 3])
@pytest.mark.parametrize("top", [200, 2])
def test_source_divergence(spark, monkeypatch, held, top):
    monkeypatch.setattr(source_divergence, "HELD_ROWS", held)
    docs = spark.createDataFrame(rows_of(ODD), SCHEMA).repartition(3)
    got = source_divergence.divergence(docs, least_docs=3 if top == 200 else 1, top=top)
    assert Counter(map(tuple, got.collect())) == plain_divergence(ODD, 3 if top == 200 else 1, 10**9, top)
    assert source_divergence.divergence(docs.limit(0)).count() == 0


def test_divergence_of_large_counts_is_exact(spark):
    texts = [("aa " * (1 + 977 * i) + "bb " * (3 + i), "en", f"s{i % 3}") for i in range(12)]
    got = source_divergence.divergence(spark.createDataFrame(rows_of(texts), SCHEMA), least_docs=1)
    assert Counter(map(tuple, got.collect())) == plain_divergence(texts, 1, 10**9, 200)


def plain_collocations(rows, least, top, percent):
    f, n = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda c: c[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            inside = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= percent * a for b in inside):
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return Counter(out)


PHRASES = [
    ("New York City is big. New York, new york city!\nnew York\tcity new\x0byork", "en", "a"), ("new york new york new york", None, "a"), ("new york new york", "und", "b"), (None, "en", "a"), ("", None, None),
    ("a a a a a a", "en", "a"), ("é é\xa0é É é é ", "fr", "a"), ("b c d b c d b c d. c d", "fr", "b"), ("b c d b c d b c d. c d", "fr", "b"), ("x " * 300 + "new york city", "en", "c"), ("." * 40, "xx", "a"),
    (" ".join(f"w{i % 7} v{i % 3}" for i in range(200)), "de", "a"),
]


@pytest.mark.parametrize(("least", "top", "bits"), [(2, 2000, 24), (2, 2, 16), (4, 5, 8), (300, 9, 16)])
def test_collocations(spark, least, top, bits):
    texts = PHRASES + ([("red fish " * 400, "en", "a")] if least > 255 else [])
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = collocations.collocations(docs, least=least, top=top, bits=bits)
    assert Counter(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain_collocations(texts, least, top, 50)


def test_collocations_in_many_slices_and_of_nothing(spark, monkeypatch):
    from weftgraph.llm import tokens

    monkeypatch.setattr(tokens.slices, "__defaults__", (40,))
    docs = spark.createDataFrame(rows_of(PHRASES), SCHEMA).coalesce(1)
    got = collocations.collocations(docs, least=2, bits=16)
    assert Counter(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain_collocations(PHRASES, 2, 2000, 50)
    assert collocations.collocations(docs.limit(0), bits=16).count() == 0


LONG, OTHER = "é<p>long</p>" * 100, "<p>other</p>" * 100
PAGES = [
    (1, "http://www.Example.com/a?b=1#c", LONG, 1), (2, "https://example.com:8080/ü x\r\ny", LONG, 2), (3, None, OTHER, 3), (4, "no scheme", "short", 4), (5, "http://a.b/", "short", 5), (6, "http://a.b/", None, 6),
    (7, "http://a.b/", "", 7), (None, "http://n.n/", LONG, 8), (None, None, OTHER, 9), (9, "http://t.t/", OTHER, 10), (9, "http://t.t/", OTHER, 11), (9, "http://t.t/", OTHER, 12), (9, "http://s.t/", OTHER, 13),
    (-5, "http://m.m/", "WARC/1.1\r\n\r\n" * 90, 14), (10, "http://user@h.h?q", "x" * 1000, 15), (11, "http://h.h", "x" * 1000, 16), (12, "http://h.h", "y" * 999, 17), (13, "http://h.h", "y" * 999, 18), (13, "http://h.h", "y" * 999, 18),
]
PAGE_SCHEMA = "page_id long, url string, html string, digest int"


def plain_records(rows):
    groups = defaultdict(list)
    for page, url, html, _ in rows:
        groups[html or ""].append((page is not None, page or 0, url is not None, url or ""))
    out = []
    for html, members in groups.items():
        data = html.encode()
        best = max(members)
        for i, m in enumerate(sorted(members, reverse=True)):
            response = len(data) < 1000 or i == 0
            out.append((m[1] if m[0] else None, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit", None if response else best[1]))
    return Counter(out)


@pytest.mark.parametrize(("lines", "part_blocks", "archive_bytes"), [(1000, 1000, 1 << 28), (2, 1, 1500), (1, 2, 1)])
def test_archives(spark, tmp_path, lines, part_blocks, archive_bytes):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA).repartition(3)
    got = warc.archived(pages, str(tmp_path), payloads=True, lines=lines, part_blocks=part_blocks, archive_bytes=archive_bytes).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == plain_records(PAGES)
    assert Counter(r["payload"].decode() for r in got if r["record_type"] == "response") == Counter(h or "" for (_, _, h, _), n in Counter(PAGES).items() for _ in range(n) if len((h or "").encode()) < 1000) + Counter({h for _, _, h, _ in PAGES if h and len(h.encode()) >= 1000})


def test_archives_are_warc_files_of_one_member_a_record(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(PAGES, PAGE_SCHEMA).repartition(2), str(tmp_path)).count()
    names, records = [], 0
    for file in tmp_path.glob("archive*"):
        rest = gzip.decompress(file.read_bytes())
        while rest:
            head, rest = rest.split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size, records = int(fields["Content-Length"]), records + (fields["WARC-Type"] != "warcinfo")
            names.append(fields["WARC-Record-ID"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            rest = rest[size + 4 :]
    assert records == len(PAGES) and len(set(names)) == len(names)


def test_search_by_url(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    index = warc.build_index(warc.write_archives(pages, str(tmp_path)), str(tmp_path), lines=2, part_blocks=1)
    asked = spark.createDataFrame([("http://A.b/",), ("http://absent/",), ("http://h.h",), (None,)], "url string")
    got = warc.read_captures(index, warc.find_captures(index, warc.captures_of_urls(asked))).collect()
    assert sorted((r["page_id"] is not None, r["page_id"] or 0) for r in got) == [(False, 0), (True, 3), (True, 5), (True, 6), (True, 7), (True, 11), (True, 12), (True, 13), (True, 13)]


def test_a_damaged_record_is_told():
    digest = hashlib.sha1(b"payload").hexdigest()
    good = warc.page_record(1, "http://a/", b"payload", digest, None, False, False)
    assert warc.read_record(good)["payload"] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        warc.read_record(warc.page_record(1, "http://a/", b"payloaf", digest, None, False, False))


def test_no_pages(spark, tmp_path):
    assert warc.archived(spark.createDataFrame([], PAGE_SCHEMA), str(tmp_path)).count() == 0


def test_url_keys():
    keys = ["http://www.Example.com/a?b=1#c", "https://example.com:8080/x y", "no scheme", None, "http://u@h.h?q"]
    assert list(map(warc.url_key, keys)) == ["com,example,www)/a?b=1", "com,example:8080)/x%20y", ")no%20scheme", "", "h,h)?q"]
