"""Filter audit, Merkle manifest and URL filters against brute force, with the edge cases that their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cellshift.llm import filter_audit, merkle_manifest, url_filters
from tests.llm.test_operators import TEXTS, documents

LETTERS = "ABCDE"


def failed(text, copied):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    out = {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    return out | ({"E"} if copied else set())


def brute_audit(rows, labels):
    """rows (doc_id, text, lang), labels (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out, shapley, alone = defaultdict(Counter), Counter(), Counter()
    for i, text, lang in rows:
        fails, part = failed(text, i is not None and first[text or ""] < i), lang or ""
        for order in filter_audit.ORDERS:
            gone = False
            for step, x in enumerate(order, 1):
                cell = out[part, order, step]
                here = x in fails and not gone
                cell["redundant"] += x in fails and gone
                cell["kept"] += not (x in fails or gone)
                cell["removed"] += here
                cell["good_lost"] += here and i in good
                cell["toxic_lost"] += here and i in toxic
                shapley[part, x] += here
                gone |= here
        for x in LETTERS:
            alone[part, x] += fails == {x}
    return {(p, o, s): (*(c[k] for k in filter_audit.COUNTERS), alone[p, o[s - 1]], shapley[p, o[s - 1]]) for (p, o, s), c in out.items()}


@pytest.mark.parametrize("hot", [10_000, 8])
def test_filter_audit(spark, monkeypatch, hot):
    """A group of copies of a third of all rows, met by broadcast and by shuffle."""
    monkeypatch.setattr(filter_audit, "HOT", hot)
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 120, 160]))) for _ in range(30)]
    texts = [*TEXTS, *base, base[0].upper(), base[1] + " 100%", " ".join(["same word"] * 80), *[base[2]] * 30, *base[:5], "word\x1cother\x85é " * 40]
    ids = [i if i % 11 else None for i in range(len(texts))]
    ids[-3:] = [5, 5, 7]
    langs = [rng.choice(["en", "de", None, ""]) for _ in texts]
    docs = documents(spark, texts, ids).drop("lang")
    rows = list(zip(ids, texts, langs, strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as part", "'x' as mask", "'x' as n", "'x' as row", "'x' as total", "'x' as good").repartition(7)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (999, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, told).collect()
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 1800
    assert {(r["part"], r["filter_order"], r["step"]): (*(r[c] for c in filter_audit.COUNTERS), r["unique_fails"], r["shapley"]) for r in got} == want
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in got)
    assert filter_audit.audit(docs.where("false"), told).count() == 0


def test_wide_counters_do_not_overflow(spark, monkeypatch):
    """Fields hold as many documents as there are; sums over many tasks, parts and full integers come out whole."""
    monkeypatch.setattr(filter_audit, "HELD", 3)
    for width in (1, 5, 37):
        most = (1 << width) - 1
        fields = filter_audit.unpacked(most * filter_audit.packed(31, True, True, width), width)
        assert fields.max() == most and fields[:, 1].tolist() == [most, 0, 0, 0, 0] * 120 and fields[:, 0].max() == 0
    rows = spark.range(3000, numPartitions=9).selectExpr("cast(id % 50 as string) as part", "cast(31 as int) as mask", "true as good", "false as toxic")
    width = (3000).bit_length()
    sums = filter_audit.added(filter_audit.added(filter_audit.wide_sums(rows, width), ["part", "task"]), ["part"]).collect()
    assert len(sums) == 50
    for r in sums:
        fields = filter_audit.unpacked(int.from_bytes(r["total"], "little"), width)
        assert fields[:, 1].tolist() == fields[:, 3].tolist() == [60, 0, 0, 0, 0] * 120 and fields[:, 2].sum() == 60 * 4 * 120


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encode(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text)."""

    def climb(nodes):
        """Root of a list of digests and the (before, behind) steps of each."""
        at, steps = list(range(len(nodes))), [[] for _ in nodes]
        while len(nodes) > 1:
            for i, k in enumerate(at):
                run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
                steps[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
            nodes, at = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [k // 8 for k in at]
        return nodes[0] if nodes else None, steps

    groups = defaultdict(list)
    for row in rows:
        leaf = sha(*map(encode, row))
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf, row))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    lower = {g: climb([x[2] for x in sorted(groups[g])]) for g in langs}
    root, upper = climb([lower[g][0] for g in langs])
    out = []
    for g, above in zip(langs, upper, strict=True):
        for (_, _, leaf, row), steps in zip(sorted(groups[g]), lower[g][1], strict=True):
            way = steps + above
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            folded = sha(*map(encode, (*row[:4], text)))
            for before, behind in way:
                folded = sha(before, folded, behind)
            out.append((row[0], leaf, lower[g][0], root, sha(*(b + a for b, a in way)), folded, folded == root))
    return out


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[("en", 1)], [("en", 8), (None, 1), ("", 2), ("zß", 9)], [("en", 600), ("de", 65), *[(f"l{i}", 1) for i in range(9)]]])
@pytest.mark.parametrize("levels", [4, 1])
def test_merkle_manifest(spark, monkeypatch, sizes, levels):
    """With one level a block every run is a block of its own, so that trees of blocks stand on blocks."""
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    rng = random.Random(4)
    rows = []
    for lang, n in sizes:
        rows += [(rng.choice([None, i, i, i, i // 2]), rng.choice(["s", None, ""]), lang, rng.choice([None, 7]), rng.choice(["", None, "Some Text É", "lower", TEXTS[6]])) for i in range(n)]
    docs = spark.createDataFrame(rows, MANIFEST).selectExpr("*", "'x' as grp", "'x' as node", "'x' as rank", "'x' as n", "'x' as leaf", "'x' as root").repartition(5)
    got = [tuple(r) for r in merkle_manifest.manifest(docs).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)


def test_merkle_manifest_of_several_blocks(spark):
    """More than one block of 4,096 leaves, the last one short; one long text; repeated rows."""
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(4100)] + [(9, "s", "de", 1, "Copy")] * 40 + [(10, "s", "de", None, "Long WORDS " * 100_000)]
    docs = spark.createDataFrame(rows, MANIFEST).repartition(5)
    got = Counter(tuple(r) for r in merkle_manifest.manifest(docs).collect())
    assert got == Counter(brute_manifest(rows))
    assert merkle_manifest.manifest(docs.where("false")).count() == 0


def brute_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    word = next((w for w in url_filters.HOST_WORDS if w in host), None)
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "block" if word else "allow", word


def test_url_filters(spark):
    rng = random.Random(2)
    hosts = ["com", "example.com", "EXAMPLE.com", "www.example.com", "a.www.example.com", "notexample.com", "net", "x.net", "org", "xcom", "casino.org", "my-casino.example.com", "é.net", "", "com:80", "a/com"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1", "/fr/2/en/", "/x.com/en/", "/x/casino", "?q=/en/", "#/es/", "//en/", "/en/?x=://net/es/"]
    urls = [f"{rng.choice(['http', 'https', 'HTTP', ''])}{rng.choice(['://', '://', '://', ':/'])}{h}{p}{rng.choice(['', '?a=1', '#top'])}" for h in hosts for p in paths]
    urls += [None, "", "://", "no url", "http://example.com" + "/en/" * 50_000, "http://" + "a." * 3000 + "net/es/", "http://" + "x" * 200_000 + ".com/"]
    rows = [(i if i % 7 else None, u) for i, u in enumerate(urls)] + [(3, urls[3]), (3, urls[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "'x' as rule", "'x' as html").repartition(3)
    got = Counter(tuple(r) for r in url_filters.judge(pages).collect())
    assert got == Counter((i, *brute_judge(u)) for i, u in rows)
    assert url_filters.judge(pages.where("false")).count() == 0


def test_automaton_runs_over_words():
    """Globs longer than a machine word, runs in the middle, and ends that must be met exactly."""
    glob = lambda s: [url_filters.ANY if c == "@" else url_filters.SEGMENT if c == "*" else ord(c) for c in s]
    patterns = ["a" * 100, "a*b", "a@b", "@", "*", "x" * 63 + "*" + "y" * 70 + "@", "", "ab*"]
    machine = url_filters.automaton([glob(p) or [] for p in patterns if p])
    rules = [re.compile("".join(".*" if c == "@" else "[^/]*" if c == "*" else re.escape(c) for c in p), re.S) for p in patterns if p]
    rng = random.Random(1)
    texts = ["a" * 100, "a" * 101, "ab", "a/b", "", "x" * 63 + "zz" + "y" * 70 + "/tail", *["".join(rng.choice("ab/") for _ in range(rng.randrange(6))) for _ in range(300)]]
    got = machine.matches([t.encode() for t in texts])
    assert [[bool(x) for x in row] for row in got] == [[r.fullmatch(t) is not None for r in rules] for t in texts]
