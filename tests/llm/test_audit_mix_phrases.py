"""Filter audit, source mixing and collocations against brute force and awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations
from zlib import crc32

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tallyglass.llm import collocations, filteraudit, mixing, queries

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, mask string, size string, n string, rest string, cells int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, "m", "s", "n", "r", 1) for i, t, lang, src in rows], DOC)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_collocations", "op13_mixing"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    found = [tuple(r) for r in got.select(*want.columns).collect()]
    assert Counter(found) == Counter(want.fetchall()) and found  # doubles to the last bit


# --- 11 filter interaction audit


def brute_audit(rows, labels):
    fails = {
        "A": lambda i, t: len(words_of(t)) < 100,
        "B": lambda i, t: 100 * len(set(words_of(t))) < 80 * len(words_of(t)),
        "C": lambda i, t: 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
        "D": lambda i, t: bool(re.search(r"[#$%&*|]", t)),
        "E": lambda i, t: i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in rows),
    }
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    docs = [(i, lang or "", {f for f in "ABCDE" if fails[f](i, t or "")}) for i, t, lang, _ in rows]
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in docs}:
        own = [(i, bad) for i, p, bad in docs if p == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                redundant = sum(f in bad for _, bad in own) - len(removed)
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(bad == {f} for _, bad in own),
                                                   sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def mixed_texts():
    r = random.Random(11)
    rare = [f"w{k}" for k in range(400)]
    texts = [" ".join(r.choices(rare[:n], k=k)) for n, k in ((400, 30), (400, 150), (60, 150), (400, 101), (30, 40))]
    texts += [t.upper() for t in texts] + [t + " #5" for t in texts[:3]] + ["", " \n\t ", "ÄÖ É𝄞 x", None, "A" * 12 + " b" * 100]
    return texts


def test_audit_equals_brute_force(spark):
    r = random.Random(12)
    texts = mixed_texts()
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""]), "s") for i in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 150, 2)]
    got = audited(filteraudit.audit(rows_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == brute_audit(rows, labels) and len(got) == 3 * 600


def test_audit_awkward_rows(spark):
    long = " ".join(f"v{i}" for i in range(40_000))
    rows = [(1, "a", "en", "s"), (1, "a", "en", "s"), (None, "a", "en", "s"), (2, "a", "de", "s"), (3, None, None, None), (4, "", None, "s"), (5, long, "en", "s")]
    labels = [(1, 1, 0), (1, 0, 1), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audited(filteraudit.audit(rows_of(spark, rows), marks))
    assert got["de", "EABCD", 1] == (0, 1, 0, 0, 0, 0, 60)  # its text stands under a smaller id, in another part
    assert got["en", "EABCD", 1][:2] == (4, 0)  # equal ids are not smaller; a row without an id has none before it
    assert got["en", "ABCDE", 1] == (1, 3, 0, 3, 2, 2, 3 * 120)
    assert got["", "EABCD", 1] == (1, 1, 0, 0, 0, 0, 60)  # NULL and empty texts are the same
    assert filteraudit.audit(rows_of(spark, []), marks).count() == 0
    assert filteraudit.audit(rows_of(spark, rows), marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


# --- 12 collocations


def brute_phrases(rows, max_n=3, min_count=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, _ in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang or "und"] += len(w)
            for k in range(1, max_n + 1):
                f[lang or "und"].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        inner = defaultdict(int)
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        scored = []
        for p, a in cand.items():
            if p in inner and 100 * inner[p] >= percent * a:
                continue
            score, k = min((math.floor(Fraction(1000000 * a * a, c[p[:k]] * c[p[k:]])), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, le, ri, n[lang], -s) for i, (s, a, p, le, ri) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def chatter(seed, docs=120, langs=("en", "de x%\n", None)):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "New", "york", "\x01x", "x\x01", "é", "𝄞", "a-b", "#", "x", "xx"] + [f"w{k}" for k in range(25)]
    weights = [30, 10, 12] + [3] * (len(vocabulary) - 3)
    gaps = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b", "; ", " ?! ", "\x0c\r"]
    text = lambda: "".join(w + r.choice(gaps) for w in r.choices(vocabulary, weights, k=r.randint(0, 220)))
    return [(i, text() if i % 17 else None, r.choice(langs), "s") for i in range(docs)]


def mined(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("max_n", [2, 3, 5])
def test_collocations_equal_brute_force(spark, max_n):
    rows = chatter(max_n)
    want = brute_phrases(rows, max_n)
    assert mined(collocations.collocations(rows_of(spark, rows), max_n=max_n)) == want and len(want) > 50


def test_collocations_in_small_memory(spark, monkeypatch):
    """Texts cut into slices in the middle, words numbered anew, counts handed on early, first words dealt to many tasks."""
    rows = chatter(7)
    for name, value in (("SLICE_BYTES", 16), ("MOST_WORDS", 40), ("MOST_HELD", 60), ("BLOCK_WORDS", 11), ("OUT_ROWS", 5), ("HOT", 10_000), ("RANK_PARTS", 3)):
        monkeypatch.setattr(collocations, name, value)
    assert mined(collocations.collocations(rows_of(spark, rows), top=40)) == brute_phrases(rows, top=40)


def test_counter_hands_on_in_small_memory(monkeypatch):
    """The same counter in this process, where its limits are certainly those set here."""
    for name, value in (("SLICE_BYTES", 16), ("MOST_WORDS", 40), ("MOST_HELD", 60), ("BLOCK_WORDS", 11), ("OUT_ROWS", 5)):
        monkeypatch.setattr(collocations, name, value)
    hot = frozenset(crc32(collocations._head("en", w)) for w in (b"the", b"of"))
    counter, got, slots = collocations._Counter(3, collocations._suffixes(hot)), Counter(), defaultdict(set)
    batches = []
    rows = chatter(8)
    for _, t, lang, _ in rows:
        batches += counter.add(lang or "und", (t or "").encode())
    batches += counter.drain()
    assert len(batches) > 100 and max(b.num_rows for b in batches) <= 5
    for b in batches:
        for slot, key, n in zip(*[c.to_pylist() for c in b.columns]):
            got[key] += n
            slots[key].add(slot)
    want = Counter()
    for _, t, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")):
            w = [x.encode() for x in re.findall(r"[^\x20\x09]+", piece)]
            want.update(collocations._head(lang or "und", w[i]) + b"".join(x + b" " for x in w[i + 1 : i + 3]) for i in range(len(w)))
    assert got == want
    assert all(len(own) == 1 for own in slots.values())  # a suffix goes to one task, whatever its task's numbers
    by_first = defaultdict(set)
    for key, own in slots.items():
        by_first[key.split(b" ")[0]] |= own
    assert {k for k, own in by_first.items() if len(own) > 1} == {b"the\nen", b"of\nen"}


def test_words_are_totalled_in_small_memory(monkeypatch):
    for name, value in (("SLICE_BYTES", 16), ("MOST_WORDS", 40), ("OUT_ROWS", 5)):
        monkeypatch.setattr(collocations, name, value)
    rows = [(lang or "und", (t or "").encode()) for _, t, lang, _ in chatter(9)] + [("en", b""), ("x y", b" a\tB.b\x0b;")]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part])], ["lang", "text"]) for part in (rows[:50], rows[50:])]
    out, got, want = list(collocations._total(iter(batches))), Counter(), Counter()
    for lang, slot, n in (x for b in out for x in zip(*[c.to_pylist() for c in b.columns])):
        got[lang, slot] += n
    for lang, t in rows:
        want.update((lang, crc32(collocations._head(lang, w))) for w in re.split(rb"[ \t.,;:!?\x0A-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), t)) if w)
    assert got == want and len(out) > 20 and max(b.num_rows for b in out) <= 5


def test_languages_are_quoted_once_and_not_for_each_word(monkeypatch):
    quoted = []
    monkeypatch.setattr(collocations, "quote", lambda x, put=collocations.quote, **k: quoted.append(x) or put(x, **k))
    counter = collocations._Counter(3, collocations._suffixes(frozenset()))
    for lang in ("en", "x y"):
        assert list(counter.add(lang, b" ".join(b"w%d" % i for i in range(500)))) == []
    assert sum(b.num_rows for b in counter.drain()) == 1000 and sorted(quoted) == ["en", "x y"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_prefixes_go_on_over_batches(size):
    r = random.Random(size)
    rows = Counter()
    for _ in range(300):
        w = r.choices([b"a", b"ab", b"b", b"\x01", "é".encode()], [5, 2, 2, 1, 1], k=r.randint(1, 3))
        rows[collocations._head(r.choice(["en", "x y"]), w[0]) + b"".join(x + b" " for x in w[1:])] += r.randint(1, 4)
    keys = [k for k in sorted(rows, reverse=True) for _ in range(r.randint(1, 2))]  # a suffix may come from several tasks
    want = Counter()
    for k in keys:
        words = k.split(b" ")[:-1]
        first, lang = words[0].split(b"\n")
        for d in range(len(words)):
            want[lang.decode().replace("%20", " "), b" ".join([first, *words[1 : d + 1]]), d + 1] += rows[k]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size], pa.binary()), pa.array([rows[k] for k in keys[i : i + size]], pa.int64())], ["key", "n"]) for i in range(0, len(keys), size)]
    for hot in (frozenset(), frozenset([crc32(collocations._head("en", b"a"))])):
        got = [x for b in collocations._prefixes(10, 3, hot)(iter(batches)) for x in zip(*[c.to_pylist() for c in b.columns])]
        few = lambda lang, phrase, d: bool(hot) and d < 3 and lang == "en" and phrase.split(b" ")[0] == b"a"
        assert sorted(got) == sorted((*k, n) for k, n in want.items() if n >= 10 or few(*k)) and got
    assert list(collocations._prefixes(10, 3, frozenset())(iter([]))) == []


def test_collocations_score_is_exact(spark):
    """Products beyond 64 bits."""
    big = [(10**12 + 7, 10**13 + 1, 10**12 + 9), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (10, 10, 10**15 - 1)]
    df = spark.createDataFrame(big, "a long, l long, r long")
    got = [r.s for r in df.select(collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()]
    assert got == [1000000 * a * a // (le * ri) for a, le, ri in big]


def test_collocations_awkward_rows(spark):
    long = "new york " * 30_000 + "q" * 300_000 + " new york"
    rows = [(1, "A b. " * 12, "en", "s"), (1, "A b. " * 12, "en", "s"), (None, None, None, None), (2, "", "en", "s"), (3, long, "xx", None)]
    got = mined(collocations.collocations(rows_of(spark, rows)))
    assert got == brute_phrases(rows)
    assert ("en", 1, "a b", 24, 24, 24, 48, 1000000) in got
    assert mined(collocations.collocations(rows_of(spark, []))) == [] == mined(collocations.collocations(rows_of(spark, rows[2:4])))
    with pytest.raises(ValueError):
        collocations.collocations(rows_of(spark, rows), max_n=6)


# --- 13 mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Resharing as it is told: targets above their limit stop, and the excess goes to the others, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = Fraction(share) * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in stopped]
        left = total - sum(most * sizes[s] for s in stopped)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return target | {s: Fraction(most * sizes[s]) for s in stopped}
        stopped |= above


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_resharing_step_by_step(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{k}": int(10 ** r.uniform(0, 5)) for k in range(r.randint(1, 25))} | {None: r.choice([0, 7, 9000]), "é": 50, "𝄞": 60, "ｚ": 5}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {x.source: x.target for x in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(float(want[s]), rel=1e-9) for s in want)


def test_mix_emits_what_the_plan_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("mix_copy", F.lit("x")).withColumn("_copies", F.lit(3))
    plan = {r.doc_id: r for r in mixing.plan_mix(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns[:-2], "_copies", "mix_copy"]
    taken = defaultdict(list)
    for r in out.collect():
        taken[r.doc_id].append(r.mix_copy)
    for i, p in plan.items():
        assert sorted(taken[i]) == list(range(1, p.copies + 1)) and p.copies <= 2
        assert p.copies in (math.floor(p.rate), math.floor(p.rate) + 1) and (p.copies > p.rate) == (p.draw < p.rate - math.floor(p.rate) and p.rate % 1 > 0)


def test_mix_comes_near_its_targets(spark):
    """Many documents: within four standard deviations of the draws; other seeds draw otherwise, reruns alike."""
    r = random.Random(3)
    rows = [(i, "w " * r.randint(1, 200), "en", r.choice(["a", "a", "b", "c", None])) for i in range(8000)]
    df = rows_of(spark, rows)
    plan = mixing.plan_mix(df).collect()
    assert {x.doc_id: x.copies for x in plan} == {x.doc_id: x.copies for x in mixing.plan_mix(df.repartition(7)).collect()}
    assert {x.doc_id: x.copies for x in plan} != {x.doc_id: x.copies for x in mixing.plan_mix(df, seed="other").collect()}
    by = defaultdict(list)
    for x in plan:
        by[x.source].append(x)
    assert len(by) == 4
    for own in by.values():
        f = own[0].rate % 1
        sd = math.sqrt(sum(x.size**2 for x in own) * f * (1 - f))
        assert abs(sum(x.size * x.copies for x in own) - own[0].target) <= 4 * sd + 1e-6
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * sum(x.size for x in plan))


def test_mix_awkward_rows(spark):
    long = "w " * 60_000
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "a b c", "en", "s"), (2, None, "en", None), (3, " \n ", "en", "none"), (4, long, "en", "t")]
    got = mixing.plan_mix(rows_of(spark, rows)).collect()
    assert len(got) == 6 and len({(x.copies, x.draw) for x in got if x.doc_id == 1}) == 1
    none = {x.source: x for x in got if x.source_size == 0}
    assert set(none) == {None, "none"} and all(x.rate == 0 == x.copies == x.target for x in none.values())
    assert max(x.copies for x in got) <= 2 and {x.size for x in got} == {0, 2, 3, 60_000}
    assert mixing.plan_mix(rows_of(spark, [])).count() == 0 == mixing.mix(rows_of(spark, [])).count()
    only_blank = mixing.plan_mix(rows_of(spark, rows[3:5])).collect()
    assert len(only_blank) == 2 and all(x.copies == 0 for x in only_blank)
