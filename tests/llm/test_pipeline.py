"""Each pipeline stage against brute force on its own input, on the smallest table."""

import collections
import random
import re

import pytest

import corpus_pipeline
from seriesloom.llm import components, covering_simhash, fertility_rules, shingle_copies
from seriesloom.llm.shared import stored
from tests.llm.test_brute_force import SF, repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out.append((name, docs))
    return out


def pair(steps, name):
    names = [n for n, _ in steps]
    at = names.index(name)
    return steps[at - 1][1].collect(), steps[at][1].collect()


def test_columns_stay(steps):
    assert [n for n, _ in steps[1:]] == [n for n, _ in corpus_pipeline.STAGES]
    assert all(df.columns == COLUMNS for _, df in steps[:-1]) and steps[-1][1].columns == [*COLUMNS, "copies"]


def test_quality_rules(spark, steps):
    before, after = pair(steps, "quality_rules")
    kept = {r.doc_id for r in fertility_rules.quality_verdicts(spark.createDataFrame(before)).collect() if r.kept}
    assert sorted(after) == sorted(r for r in before if r.doc_id in kept)
    assert all(len(r.text.split()) >= 50 for r in after)


def near_copies(rows, radius=2):
    """Brute force: names after SimHash links, then after links of similar shingle sets between what stays."""
    prints = {d: covering_simhash.simhash(t) for d, t in rows}
    words = {d: (t or "").lower().split() for d, t in rows}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items() if w}
    name = {d: d for d in prints}

    def link(a, b):
        low, high = sorted((name[a], name[b]))
        if low != high:
            name.update({d: low for d, n in name.items() if n == high})

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                link(a, b)
    left = [d for d in ids if name[d] == d and d in sets]
    for i, a in enumerate(left):
        for b in left[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                link(a, b)
    return name


def test_simhash_dedup(steps):
    before, after = pair(steps, "simhash_dedup")
    name = near_copies([(r.doc_id, r.text) for r in before])
    assert sorted(after) == sorted(r for r in before if name[r.doc_id] == r.doc_id)
    assert len(after) < len(before)


@pytest.mark.parametrize("below", [48, 2])
def test_copies_of_any_similarity_go(spark, below):
    draw, rows = random.Random(3), []
    for group in range(40):
        words = [f"w{draw.randrange(50_000)}" for _ in range(draw.choice([60, 300, 1000]))]
        rows.append((group * 10, " ".join(words)))
        for k in range(1, 5):
            changed = list(words)
            for at in draw.sample(range(len(words)), max(1, len(words) * k // 200)):
                changed[at] = f"x{draw.randrange(50_000)}"
            rows.append((group * 10 + k, " ".join(changed)))
    shared = " ".join(f"c{i}" for i in range(40))
    rows += [(1000 + i, f"{shared} " + " ".join(f"y{draw.randrange(50_000)}" for _ in range(60))) for i in range(100)]  # a passage alone makes no copy
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "One  two")]
    name = near_copies(rows)
    kept = {r.doc_id for r in shingle_copies.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"), pairs_below=below).collect()}
    assert kept == {d for d, n in name.items() if d == n}
    assert sum(d < 1000 for d in kept) < 100


def test_links_are_followed_once(spark, monkeypatch):
    """What is connected already is not handed to the search for components again, and an empty search makes no round."""
    draw, calls, found = random.Random(5), [], shingle_copies.components

    def watched(links, a="a", b="b"):
        calls.append([tuple(r) for r in links.select(a, b).distinct().collect()])
        return found(links, a, b)

    monkeypatch.setattr(shingle_copies, "components", watched)
    rows = []
    for group in range(6):
        words = [f"w{draw.randrange(50_000)}" for _ in range(300)]
        rows += [(group * 10 + k, " ".join([*words[:200], f"x{draw.randrange(50_000)}", *words[200:]])) for k in range(4)]
    kept = shingle_copies.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"), radius=0)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10, 20, 30, 40, 50]
    links = [link for call in calls for link in call]
    assert links and len(links) == len(set(links))


def test_small_tables_take_few_tasks_and_files(spark, monkeypatch):
    """Of many shuffle partitions that Spark may not coalesce, a search of few links uses no more than there are cores."""
    files, kept = [], components.stored

    def watched(df, label):
        out = kept(df, label)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "stored", watched)
    settings = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = components.components(spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in found) == [(i, 0) for i in range(401)]
    assert len(files) > 2 and max(files[1:]) <= spark.sparkContext.defaultParallelism


def test_open_pairs_are_compared_at_once(spark, monkeypatch):
    """However often large buckets are split, what stays open in small ones is compared once, and no copy is lost."""
    draw, labels, calls, kept, found = random.Random(8), [], [], shingle_copies.stored, shingle_copies._similar
    monkeypatch.setattr(shingle_copies, "stored", lambda df, label: (labels.append(label), kept(df, label))[1])
    monkeypatch.setattr(shingle_copies, "_similar", lambda *a: (calls.append(1), found(*a))[1])
    common, rows = [f"c{k}" for k in range(200)], []
    for group in range(60):
        own = [f"w{draw.randrange(50_000)}" for _ in range(90)]
        rows += [(group * 10 + k, " ".join([*common, *own[:45], *[f"x{draw.randrange(50_000)}"] * k, *own[45:]])) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = sorted(r.doc_id for r in shingle_copies.drop_copies(docs, radius=0, pairs_below=8).collect())
    assert ids == [group * 10 for group in range(60)]
    assert labels.count("buckets") > 1 and len(calls) == labels.count("buckets") + 1


@pytest.mark.parametrize("share", [0.8, 0.85, 0.9, 0.95])
def test_recall_in_large_buckets(spark, share):
    """Texts that share most shingles but are no copies fill large buckets; copies among them are found all the same."""
    draw, rows = random.Random(9), []
    common = [f"c{i}" for i in range(140)]
    for i in range(60):
        words = common + [f"{i}w{draw.randrange(10**6)}" for _ in range(60)]
        rows.append((2 * i, " ".join(words)))
        changed, cut = list(words), 140
        while True:  # replace words at the end until the wanted similarity
            nxt = list(changed)
            nxt[cut] = f"{i}x{draw.randrange(10**6)}"
            a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, nxt))
            if len(a & b) < share * len(a | b):
                break
            changed, cut = nxt, cut + 1
        rows.append((2 * i + 1, " ".join(changed)))
    found = shingle_copies.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"), pairs_below=8, radius=0)
    kept = {r.doc_id for r in found.collect()}
    assert kept >= {2 * i for i in range(60)} and sum(2 * i + 1 not in kept for i in range(60)) >= 57


def test_odd_rows_in_dedup(spark):
    long = " ".join(f"w{i % 9973}" for i in range(120_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long + " tail"), (6, "a b c d e f g"), (6, "a b c d e f g"), (None, "a b c d e f g"), (None, "q r s"), (None, "q r s"), (7, "Q R  s"), (8, "é")]
    df = spark.createDataFrame([(d, t, 1, 2, "x", 3) for d, t in rows], "doc_id long, text string, row_key int, fp int, bands string, n int").repartition(3)
    kept = shingle_copies.drop_copies(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, None), (4, long), (6, "a b c d e f g"), (7, "Q R  s"), (8, "é")]
    assert shingle_copies.drop_copies(df.where("false")).count() == 0


def test_suffix_dedup(steps):
    before, after = pair(steps, "suffix_dedup")
    _, later = repeats([(r.doc_id, r.text) for r in before], 50)
    texts = {r.doc_id: r.text for r in after}
    for r in before:
        left = [w for k, w in enumerate(r.text.split()) if k not in later[r.doc_id]]
        assert (texts.get(r.doc_id) or "").split() == left
        if not later[r.doc_id]:
            assert texts[r.doc_id] == r.text
    assert any(later.values())


def test_decontamination(spark, steps):
    before, after = pair(steps, "benchmark_decontamination")
    fold = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = fold(item.text)
        windows |= {tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12)) if words}
    lengths = {len(w) for w in windows}
    kept = set()
    for r in before:
        words, hit = fold(r.text), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(words)):
            kept.add(r.doc_id)
    assert sorted(after) == sorted(r for r in before if r.doc_id in kept)
    assert len(after) < len(before)


def test_mixing(steps):
    before, after = pair(steps, "mixing")
    size = {r.doc_id: len(r.text.split()) for r in before}
    by = collections.Counter()
    for r in before:
        by[r.source] += size[r.doc_id]
    taken = collections.Counter()
    for r in after:
        assert 1 <= r.copies <= 3
        taken[r.source] += r.copies * size[r.doc_id]
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(by))}
    full = {s for s in by if taken[s] == 3 * by[s]}
    left = sum(by.values()) - sum(3 * by[s] for s in full)
    for s in set(by) - full:
        want = left * weight[s] / sum(weight[x] for x in set(by) - full)
        assert abs(taken[s] - want) <= max(n for d, n in size.items())


def test_run_gives_the_last_stage(spark, steps):
    key = lambda df: sorted((r.doc_id, r.copies) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(steps[-1][1])
