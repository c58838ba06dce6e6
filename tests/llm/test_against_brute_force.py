"""Operators against plain Python on rows with copies, missing values and odd texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def spaced(t, low=False):
    return SPACED.findall(lower(t) if low else t or "")


def same(got, want):
    assert collections.Counter(map(repr, got)) == collections.Counter(map(repr, want))


def top(parent, v):
    while parent[v] != v:
        v = parent[v]
    return v


def test_substring_dedup(docs, empty, rows):
    from tessera.llm.substring_dedup import substring_dedup

    size = 12
    ws = [spaced(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + size]) for w in ws for i in range(len(w) - size + 1))
    want = []
    for (i, _), w in zip(rows, ws):
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if seen[tuple(w[p : p + size])] > 1:
                gone[p : p + size] = [True] * size
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    same([tuple(r)[:4] for r in substring_dedup(docs, size).collect()], want)
    assert substring_dedup(empty, size).count() == 0


@pytest.mark.parametrize("many", [0, 64])
def test_suffix_dedup(docs, empty, rows, many, monkeypatch):
    from tessera.llm import suffix_dedup as S

    monkeypatch.setattr(S, "MANY", many)
    raw = [(math.inf if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], math.inf), i)
    want = []
    for (i, b), (doc, _) in zip(raw, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        want.append((doc, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    same([(r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), bytes(r.kept)) for r in S.suffix_dedup(docs).collect()], want)
    assert S.suffix_dedup(empty).count() == 0


def test_induced_sorting_is_suffix_sorting():
    from tessera.llm.induced import sorted_suffixes

    draw = random.Random(3)
    for _ in range(120):
        strings = ["".join(draw.choice(draw.choice(["ab", "abc", "a"])) for _ in range(draw.randint(1, 25))).encode() for _ in range(draw.randint(1, 10))]
        who, place, common = sorted_suffixes(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), draw.choice([64, 1 << 20]))
        suffixes = [strings[a][b:] for a, b in zip(who, place)]
        assert suffixes == sorted(s[k:] for s in strings for k in range(len(s)))
        for x, y, c in zip(suffixes, suffixes[1:], common[1:]):
            assert c == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def benchmark_hits(rows, items):
    """doc_id, words, places of hit words and items of each row, window by window."""
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for p in range(max(len(w) - 8, 0) + 1 if w else 0):
            windows[tuple(w[p : p + 8])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if got := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= got
        out.append((i, len(w), sorted(hit), sorted(found)))
    return out


def test_decontamination(spark, docs, empty, rows):
    from tessera.llm.decontamination import benchmark_matches, decontaminate

    source = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(1, " ".join(source[0].split()[4:20])), (2, source[1]), (10, "ONE"), (3, None), (4, ""), (5, "not there at all in any of these texts")]
    bench = spark.createDataFrame([(i, t, 3) for i, t in [*items, items[1]]], "item_id long, text string, hits int")
    want = benchmark_hits(rows, items)
    got = benchmark_matches(docs, bench).collect()
    same([(r.doc_id, r.n_words, list(r.hits), list(r["items"])) for r in got], want)
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns
    same([r.doc_id for r in clean.collect()], [i for i, _, _, f in want if not f])
    assert benchmark_matches(empty, bench).count() == 0 and decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_in_blocks(docs, spark, monkeypatch):
    from tessera.llm import decontamination as D

    texts = [t for t in (r.text for r in docs.collect()) if t and len(t.split()) > 15][:6]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    whole = [tuple(r) for r in D.benchmark_matches(docs, bench).collect()]
    monkeypatch.setattr(D, "BLOCK_BYTES", 200)
    same([tuple(r) for r in D.benchmark_matches(docs, bench).collect()], whole)
    monkeypatch.setattr(D, "SHARD_BYTES", 100)
    same([tuple(r) for r in D.benchmark_matches(docs, bench).collect()], whole)


def near_components(rows):
    """doc_id, shingles, component and verdict of each row, from all pairs of sets."""
    sets = []
    for _, t in rows:
        w = spaced(t, True)
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[top(parent, a)] = top(parent, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(parent, k)] = min(least.get(top(parent, k), i), i)
    return [(i, len(s), None if i is None else least[top(parent, k)], i is None or i == least[top(parent, k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates(docs, empty, rows, block, monkeypatch):
    from tessera.llm import similarity
    from tessera.llm.near_dedup import drop_near_duplicates, near_duplicates

    monkeypatch.setattr(similarity, "BLOCK", block)
    want = near_components(rows)
    same([tuple(r) for r in near_duplicates(docs).collect()], want)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    same([r.doc_id for r in kept.collect()], [w[0] for w in want if w[3]])
    assert near_duplicates(empty).count() == 0


def test_setsketch_registers_merge_and_estimate():
    from tessera.llm import sketch

    draw = np.random.default_rng(1)
    pool = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    both = np.concatenate([a, b])
    def reg(h):
        return sketch.registers(sketch.minima(h, np.zeros(len(h), np.int64), 1, 1024))
    assert (np.maximum(reg(a), reg(b)) == reg(both)).all()
    j = sketch.likeliest(reg(a), reg(b), np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(j - 1500 / 2500) < 0.05


def lines_left(rows):
    """Each row's id and what is left of its text, from all pairs of lines."""
    where = collections.OrderedDict()
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if i is not None and line.strip(" \t\n\v\f\r"):
                where.setdefault(line, []).append((i, k))
    names = list(where)
    sets = [{x[j : j + 8] for j in range(max(len(x) - 7, 1))} for x in names]
    parent = list(range(len(names)))
    for a in range(len(names)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 5 * small >= 4 * large and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[top(parent, a)] = top(parent, b)
    keep = {}
    for k, x in enumerate(names):
        keep[top(parent, k)] = min(keep.get(top(parent, k), (math.inf, 0)), min(where[x]))
    gone = {(i, p) for k, x in enumerate(names) for i, p in where[x] if (i, p) != keep[top(parent, k)]}
    return [(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows]


def test_line_dedup(docs, empty, rows):
    from tessera.llm.line_dedup import drop_repeated_lines, line_dedup

    want = lines_left(rows)
    out = line_dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    same([(r.doc_id, r.text) for r in out.collect()], want)
    assert line_dedup(empty).count() == 0
    assert drop_repeated_lines(docs).columns == docs.columns


@pytest.fixture(scope="module")
def vocabulary():
    return str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


def test_bpe_equals_the_tokenizers_library(docs, empty, rows, vocabulary):
    from tokenizers import Tokenizer

    from tessera.llm.bpe import bpe_decode, bpe_digest, bpe_encode

    t = Tokenizer.from_file(vocabulary)
    want = [(i, t.encode(x or "", add_special_tokens=False).ids, x or "") for i, x in rows]
    for mask, least in ((511, 64), (7, 2)):
        got = bpe_decode(bpe_encode(docs, vocabulary, mask, least), vocabulary).collect()
        same([(r.doc_id, list(r.ids), r.decoded) for r in got], want)
    digest = bpe_digest(docs, vocabulary).collect()
    same([(r.doc_id, r.n_tokens, r.ids_sha256) for r in digest], [(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x, _ in want])
    assert bpe_digest(empty, vocabulary).count() == 0


def test_bpe_repairs_any_cuts(vocabulary):
    from tokenizers import Tokenizer as Library

    from tessera.llm.bpe import Tokenizer, safe_places

    with open(vocabulary, encoding="utf-8") as f:
        own = Tokenizer(f.read())
    library, draw = Library.from_file(vocabulary), random.Random(2)
    for _ in range(400):
        text = "".join(draw.choice(["a", "The", " ", "  ", "\n", "'s", "é", "<|endoftext|>", "<|endo", "ftext|>", "12", "中", "　", "\t", "😀", "\r\n"]) for _ in range(draw.randint(1, 50)))
        data = np.frombuffer(text.encode(), np.uint8)
        cuts = np.array(sorted(draw.sample(range(1, len(data) + 1), min(len(data), 8))), np.int64)
        cuts = cuts[cuts < len(data)]
        cuts = cuts[(data[cuts] & 0xC0) != 0x80]
        assert own.encode(data, cuts, safe_places(data)).tolist() == library.encode(text, add_special_tokens=False).ids


def test_katz_backoff(docs, empty, rows):
    from tessera.llm import katz

    tokens = [[*spaced(t, True), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    one, two, begins = collections.Counter(), collections.Counter(), 0
    for t, h in zip(tokens, held):
        if not h:
            one.update(t)
            two.update(zip([0, *t], t))
            begins += 1
    total = sum(one.values())
    def factors(counts):
        return katz.discounts([sum(v == r for v in counts.values()) for r in range(1, katz.K + 2)])
    f1, f2 = factors(one), factors(two)
    def kept(c, f):
        return c * f[c - 1] if 0 < c <= katz.K else c
    unseen = 1 - sum(kept(c, f1) for c in one.values()) / (total + katz.ETA)
    def p1(w):
        return kept(one[w], f1) / (total + katz.ETA) if one[w] else unseen
    sums = collections.defaultdict(lambda: [0.0, 0.0])
    for (h, w), c in two.items():
        sums[h][0] += kept(c, f2)
        sums[h][1] += p1(w)
    def p(h, w):
        n = begins if h == 0 else one[h]
        if two[h, w]:
            return kept(two[h, w], f2) / (n + katz.ETA)
        return (1 - sums[h][0] / (n + katz.ETA)) / (1 - sums[h][1]) * p1(w) if n else p1(w)
    for h in [0, *[w for w in one if w][:5]]:
        assert abs(sum(p(h, w) for w in one) + p(h, "never seen") - 1) < 1e-9
    got = {(r.doc_id, r.n_tokens): r for r in katz.katz_scores(docs).collect()}
    for (i, _), t, h in zip(rows, tokens, held):
        r = got[i, len(t)]
        assert (r.held_out, r.n_known, r.train_tokens) == (h, sum(one[w] > 0 for w in t), total)
        assert abs(r.base_score - sum(math.log10((one[w] + 0.1) / (total + 0.1 * (len(one) + 1))) for w in t)) < 1e-6
        assert abs(r.score - sum(math.log10(p(a, b)) for a, b in zip([0, *t], t))) < 1e-6
    assert katz.katz_scores(empty).count() == 0


def test_text_counts(docs, empty, rows):
    from tessera.llm.quality_rules import DecisionList, apply_rules

    want = []
    for i, t in rows:
        t = t or ""
        w = spaced(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        again = [False] * len(w)
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                again[k : k + 3] = [True] * 3
        seen, doubles = set(), 0
        for line in t.split("\n"):
            doubles += bool(spaced(line)) and line in seen
            seen.add(line)
        failed = len(w) < 50 or 100 * sum(again) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), doubles, sum(again), failed, not failed))
    got = apply_rules(docs, DecisionList(())).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    same([tuple(r) for r in got.collect()], want)
    assert apply_rules(empty, DecisionList(())).count() == 0


def test_decision_list_finds_conjunctions():
    from tessera.llm.quality_rules import learn

    draw = np.random.default_rng(4)
    x = {"a": draw.random(3000), "b": draw.random(3000), "c": draw.random(3000)}
    bad = ((x["a"] > 0.7) & (x["b"] < 0.3)) | (x["c"] > 0.95)
    rules = learn(x, bad).rules
    covered = np.zeros(3000, bool)
    for r in rules:
        covered |= np.logical_and.reduce([c.holds(x) for c in r])
    assert 2 <= len(rules) and (covered == bad).mean() > 0.97
    assert learn({"a": np.zeros(0)}, np.zeros(0, bool)).rules == ()


def test_factorisation_machine(spark, empty):
    from tessera.llm import fm_quality as Q

    table = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{table}/documents.parquet"), spark.read.parquet(f"{table}/labels.parquet")
    model = Q.train(docs, labels)
    scored = Q.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in held]) > 0.9
    assert Q.score(empty, model).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "word")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in Q.score(odd, model).collect())


def test_factorisation_machine_interactions_are_linear_time_sums():
    from tessera.llm import fm_quality as Q
    from tessera.llm.words import buffers

    import pyarrow as pa

    draw = np.random.default_rng(0)
    m = Q.Machine(0.1, draw.normal(0, 0.1, Q.SIZE), draw.normal(0, 0.1, (Q.SIZE, 3)), np.zeros((len(Q.STATISTICS), Q.RANGES - 1)))
    data, offsets = buffers(pa.array(["one two three two", ""]))
    got = m.scores(data, offsets)
    text, f, x = Q.features(data, offsets, m.cuts)
    for t in (0, 1):
        k = np.flatnonzero(text == t)
        z = m.bias + (m.weight[f[k]] * x[k]).sum() + sum(m.factor[f[a]] @ m.factor[f[b]] * x[a] * x[b] for n, a in enumerate(k) for b in k[n + 1 :])
        assert abs(got[t] - 1 / (1 + math.exp(-z))) < 1e-9


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header id=top><p>Site of the people and for the people</p></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="ad">Buy the best of the best and be happy with it</div><article class="post has-sidebar"><h1>Title  of
it</h1><p>First &eacute;l&amp;b para<p>Second <a href=y>link</a> of the text, with enough words to be a long and plain block of text.<ul><li>one</li></ul>
<aside>side note of the page</aside><div class="comments"><p>A reader comment with the words of and for the people who read it all.</p></div></article><form><label>Name</label></form><footer>&copy; the end of it</footer></body></html>"""


def test_main_text(spark):
    from tessera.llm.html_text import extract_text, main_text

    assert main_text(PAGE) == "Title of it\nFirst él&b para\nSecond link of the text, with enough words to be a long and plain block of text.\none"
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "<p>cut off &am", 1), (4, "u", "<p>cut off &am", 1), (None, "u", "<<<>>><p", 1)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_without_article_marks():
    from tessera.llm.html_text import main_text

    body = "This is the first of the long paragraphs that the page has, and it is as plain as it can be for a reader who has time."
    page = f"<body><div><a href=a>One</a> <a href=b>Two</a></div><div><p>{body}</p><p>Short one.</p><p>{body}</p></div><div><a href=c>Next page of the site with a long link text that says nothing at all</a></div></body>"
    assert main_text(page) == f"{body}\nShort one.\n{body}"


def test_components(spark):
    from tessera.llm.components import components

    draw = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    parent = list(range(400))
    for a, b in edges:
        parent[top(parent, a)] = top(parent, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = collections.defaultdict(set)
    for v in {x for a, b in edges if a != b for x in (a, b)}:
        groups[top(parent, v)].add(got[v])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_dedup_of_periodic_texts(spark):
    from tessera.llm.suffix_dedup import suffix_dedup

    draw = random.Random(8)
    rows = []
    for i in range(120):
        unit = "".join(draw.choice("ab") for _ in range(draw.randint(1, 9)))
        mid = "".join(draw.choice("abc") for _ in range(draw.randint(0, 40)))
        rows.append((i, unit * draw.randint(0, 30) + mid + (rows[draw.randrange(i)][1][draw.randint(0, 30) :] if i else "")[:150]))
    first = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    want = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        want.append((i, bytes(c for c, g in zip(t.encode(), gone) if not g)))
    same([(r.doc_id, bytes(r.kept)) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()], want)


@pytest.mark.parametrize("many", [0, 64])
def test_suffix_dedup_of_passages_repeated_in_a_document(spark, many, monkeypatch):
    """A passage with the same surroundings twice in a document, or in two rows of one, of which an earlier document has a part."""
    from tessera.llm import suffix_dedup as S

    monkeypatch.setattr(S, "MANY", many)
    draw = random.Random(12)
    text = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for k in range(0, 60, 3):
        shared, left, right = text(draw.randint(50, 300)), text(120), text(120)
        rows.append((k, text(130) + shared + text(130)))
        rows.append((k + 1, "".join(left + shared + right + text(90) for _ in range(draw.randint(2, 4)))))
        rows += [(k + 2, text(80) + left + shared + right), (k + 2, left + shared + right + text(70))]
    first = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    want = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        want.append((i, len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(t.encode(), gone) if not g)))
    same([(r.doc_id, len(r.spans), bytes(r.kept)) for r in S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()], want)


def test_suffix_dedup_sends_little_and_evenly():
    """Disk: what a piece sends of its anchors is small, and no bucket gets much more than the others."""
    import pyarrow as pa

    from tessera.llm import suffix_dedup as S

    draw = random.Random(21)
    rows = pa.table({"doc_id": list(range(200)), "text": ["".join(draw.choices("abcdefgh ij klm", k=2000)) for _ in range(200)], "piece": pa.array([0] * 200, pa.int32())})
    sent, spans = S._send(50, 64)(rows), len(S.Spans(rows, 50, 64).first)
    sizes = [sum(len(sent[c][i].as_py()) for c in ("keys", "spans", "sides", "unclear", "docs")) for i in range(sent.num_rows)]
    assert sum(sizes) < 16 * spans
    assert max(sizes) < 1.5 * sum(sizes) / S.shards(64)


def test_suffix_dedup_sorts_only_what_texts_share(monkeypatch):
    """CPU time: ends that no other document's text has, and texts without anything shared, aren't sorted."""
    import pyarrow as pa

    from tessera.llm import packed
    from tessera.llm import suffix_dedup as S

    draw, sorted_bytes, real = random.Random(22), [], S.sorted_suffixes
    monkeypatch.setattr(S, "sorted_suffixes", lambda strings, sizes, *a: sorted_bytes.append(len(strings)) or real(strings, sizes, *a))
    text = lambda n: bytes(draw.choices(range(97, 123), k=n))
    common = text(60)
    texts = [text(10) + common + text(29), text(99), text(20) + common + text(19)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    rows = pa.table({"bucket": pa.array([0], pa.int32()), "piece": pa.array([3], pa.int32()), "bytes": [packed.squeeze(raw)], "sizes": [packed.small(np.array([50, 50, 50]))], "docs": [packed.narrow(np.array([7, 5, 2]))]})
    out = S._sort(50)(rows)
    gone = np.unpackbits(np.frombuffer(out["a"][0].as_py(), np.uint8), count=150)
    assert np.flatnonzero(gone).tolist() == list(range(10, 21))  # of the text of document 7
    assert sorted_bytes == [120]
    alone = rows.set_column(4, "docs", pa.array([packed.narrow(np.array([7, 7, 7]))]))
    assert S._sort(50)(alone).num_rows == 0


def test_buckets_are_compared_without_looking_at_most_sets(monkeypatch):
    """CPU time: all pairs of all buckets of a batch are settled, and sets that can't be similar aren't intersected."""
    import pyarrow as pa

    from tessera.llm import similarity as M

    draw, looked, common = np.random.default_rng(23), [], M._common
    monkeypatch.setattr(M, "_common", lambda x, y: looked.append(1) or common(x, y))
    rows, items, want, pairs = [], {}, set(), 0
    for band in range(60):
        base = draw.integers(0, 1 << 63, 300, np.uint64)
        members = list(range(10 * band, 10 * band + int(draw.integers(2, 10))))
        for k, node in enumerate(members):  # half of it shared, but every fourth is nearly the one before
            last = items.get(node - 1, base)
            items[node] = np.unique(np.concatenate([last[:290], draw.integers(0, 1 << 63, 10, np.uint64)] if k % 4 == 3 else [base[:200], draw.integers(0, 1 << 63, 100, np.uint64)]))
            rows.append((node, band, 0, 0, 0, node, items[node].tobytes()))
        for a in members:
            for b in range(members[0], a):
                pairs += 1
                both = len(np.intersect1d(items[a], items[b]))
                if 5 * both >= 4 * (len(items[a]) + len(items[b]) - both):
                    want.add((b, a))
    columns = ["node", "band", "i", "j", "block", "root", "items"]
    table = pa.table({c: pa.array([r[k] for r in rows], pa.int64() if k < 2 or k == 5 else pa.binary() if k == 6 else pa.int32()) for k, c in enumerate(columns)})
    for size in (1000, 7):  # buckets are cut by batches' ends
        looked.clear()
        got = [x for out in M._forest(4, 5, M.hashed_sets)(iter(table.to_batches(max_chunksize=size))) for x in zip(out["a"].to_pylist(), out["b"].to_pylist())]
        assert want and {tuple(sorted(x)) for x in got} == want
        assert len(looked) < 1.5 * len(want) < pairs / 5


def test_buckets_of_the_same_lines_have_one_seal():
    import pyarrow as pa

    from tessera.llm import line_dedup, packed

    keys, nodes = np.array([5, 5, 9, 9, 11, 11, 11, 20], np.uint64), np.array([70, -3, -3, 70, 70, 1, -3, 8])
    out = line_dedup._meet(pa.table({"bucket": pa.array([0], pa.int32()), "keys": [packed.pack(keys)], "nodes": [nodes.tobytes()]})).to_pylist()
    assert [(r["band"], r["node"], r["size"]) for r in out] == [(5, -3, 2), (5, 70, None), (9, -3, 2), (9, 70, None), (11, -3, 3), (11, 1, None), (11, 70, None)]
    seals = [(r["x"], r["y"]) for r in out if r["x"] is not None]
    assert seals[0] == seals[1] != seals[2]
