"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from seriesloom.llm import covering_simhash, entropy_mixing, fertility_rules, fm_decontaminate, fm_index, hierarchical_quality, language_mixture
from seriesloom.llm import components, pseudo_likelihood, separator_scan, shared, sparse_suffix, warc_chunks

LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(60_000))
ODD = [(1, "", "en", "a"), (2, None, None, None), (3, "   \n\t ", "de", "a"), (4, "é", "fr", "b"), (4, "é", "fr", "b"), (None, "some words here", "en", None), (7, LONG, "en", "a"), (8, "x" * 300_000, "en", "b")]
CLASH = "row string, row_number int, found int, copies int, measures int, kept int, base_failed int, removable int, band int, n_words int, fp int, idx int"


@pytest.fixture(scope="module")
def odd(spark):
    extra = [(*r, "r", *range(11)) for r in ODD]
    return spark.createDataFrame(extra, f"doc_id long, text string, lang string, source string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def same_columns(a, b):
    assert a.columns == b.columns and a.dtypes == b.dtypes


def test_language(odd, none):
    model = language_mixture.fit(odd)
    rows = {(r.doc_id, r.text): r.language for r in language_mixture.with_language(odd, model).collect()}
    assert len(rows) == len(set(r[:2] for r in ODD))
    assert all(rows[k].lang == "und" and rows[k].share == 0 and not rows[k].languages for k in ((1, ""), (2, None), (3, "   \n\t ")))
    assert rows[4, "é"].lang in ("fr", "en", "de") and rows[7, LONG].lang == "en"
    assert language_mixture.with_language(none, model).count() == 0
    untrained = language_mixture.fit(none)
    assert {r.language.lang for r in language_mixture.with_language(odd, untrained).collect()} == {"und"}


def test_mixture_of_two_languages(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox and the lazy dog " * 40, "en"), (2, "der schnelle braune fuchs und der faule hund " * 40, "de")], "doc_id long, text string, lang string")
    model = language_mixture.fit(docs)
    found = language_mixture.mixtures(["the quick brown fox and the lazy dog " * 20 + "der schnelle braune fuchs und der faule hund " * 20], model)[0]
    assert sorted(round(float(x), 1) for x in found) == [0.5, 0.5]


def test_mixing(odd, none):
    rows = entropy_mixing.mixed(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r.copies <= 3 for r in rows)
    assert sum(r.size for r in rows) == sum(len((t or "").split()) for _, t, *_ in ODD)
    assert entropy_mixing.mixed(none).count() == 0
    mixed = entropy_mixing.mixed_documents(odd)
    assert mixed.columns[:-1] == odd.columns and mixed.columns[-1] == "_copies"


def test_capped_targets():
    assert entropy_mixing.capped_targets({"a": 10, "b": 1000}, {"a": 1, "b": 1}, 3) == {"a": 30, "b": 980}
    assert entropy_mixing.capped_targets({}, {}, 3) == {}
    assert entropy_mixing.cycled_weights(["b", None, "a", "c"]) == {"a": 1, "b": 2, "c": 3, None: 1}


def test_rates_solve_the_dual(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 50), "s") for i in range(2000)] + [(-i, "w " * 30, "t") for i in range(1, 4000)], "doc_id long, text string, source string")
    rows = entropy_mixing.mixed(docs).collect()
    for source in "st":
        mine = [r for r in rows if r.source == source]
        assert math.isclose(sum(r.rate * r.size for r in mine), mine[0].target, rel_tol=1e-4)
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= 30
        tilt = {round(math.log(r.rate) / r.size, 9) for r in mine if 0 < r.rate < 3 - 1e-9}
        assert len(tilt) <= 1


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "some words here"), (1, "some words here"), (2, ""), (3, None), (None, "word3 other3"), (5, "nowhere to be found")], "item_id long, text string")
    rows = {r.doc_id: r for r in fm_decontaminate.with_benchmark_spans(odd, items, name="spot").collect()}
    assert rows[None].spot.items == ["1"] and rows[None].spot.n_hit == 3 and [tuple(s) for s in rows[None].spot.spans] == [(0, 3)]
    assert rows[7].spot.n_hit > 0 and rows[7].spot.items == [] and rows[2].spot.n_words == 0 and rows[1].spot.n_hit == 0
    parts = {r.doc_id: r.spot for r in fm_decontaminate.with_benchmark_spans(odd, items, name="spot", part_bytes=12).collect()}
    assert parts == {k: r.spot for k, r in rows.items()}
    kept = fm_decontaminate.drop_contaminated(odd, items)
    same_columns(kept, odd)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in ODD} - {None}
    unhit = fm_decontaminate.with_benchmark_spans(odd, items.where("false"))
    assert unhit.columns.count("found") == 1 and unhit.where("found.n_hit = 0").count() == len(ODD)
    assert fm_decontaminate.drop_contaminated(none, items).count() == 0


def test_fm_index_finds_every_place():
    import numpy as np

    draw = np.random.default_rng(3)
    for size, letters in ((1, 1), (50, 2), (3000, 3), (3000, 200), (500, 1)):
        text = draw.integers(1, letters + 1, size)
        index = fm_index.FMIndex(text, sampled=7)
        phrases = [tuple(text[i : i + n]) for n in (1, 2, 5, 13) for i in draw.integers(0, size, 5)] + [(letters, 1, letters), (letters + 1,), (1, 5000)]
        phrases = [p for p in phrases if p]
        matrix, lengths = np.zeros((len(phrases), 13), np.int64), np.array([len(p) for p in phrases])
        for row, p in zip(matrix, phrases):
            row[13 - len(p) :] = p
        low, high = index.search(matrix, lengths)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(size - len(p) + 1) if tuple(text[i : i + len(p)]) == p]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_warc(spark, odd, none):
    mark = "\r\n\r\nWARC/1.1\r\n"
    bodies = ["", None, "a", "a", mark, mark * 3 + "tail", "WARC/1.1\r\nx", "end\r\n\r\nWARC/1.1", "\r\n\r\n", "\r\n" + mark[4:], "é" * 1000 + mark + "ü" * 500, "long " * 5000, "long " * 5000, "a", "x\0y"]
    rows = [(i if i != 13 else None, "http://x/ y\r\n" if i % 2 else None, b) for i, b in enumerate(bodies)] + [(4, None, mark)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for size in (64, 1 << 18):
        chunks = warc_chunks.read_chunks(spark, warc_chunks.write_archives(pages, chunk_bytes=size))
        assert chunks.agg({"data": "max"}).count() == 1 and chunks.selectExpr("max(octet_length(data)) AS n").first().n <= size
        found = warc_chunks.records(chunks).collect()
        assert len(found) == len(rows) and all(r.intact for r in found)
        kinds = {(r.page_id, r.record_type, r.refers_to) for r in found}
        assert {(0, "response", None), (1, "revisit", 0), (2, "response", None), (3, "revisit", 2), (None, "revisit", 2), (4, "response", None), (12, "revisit", 11)} <= kinds
        assert {(r.page_id, r.payload_bytes) for r in found} == {(p, len((b or "").encode())) for p, _, b in rows}
    large = warc_chunks.records(warc_chunks.read_chunks(spark, warc_chunks.write_archives(pages, least=2)))
    assert {r.record_type for r in large.collect() if r.page_id in (0, 1, 2, 3)} == {"response"}
    assert warc_chunks.records(warc_chunks.read_chunks(spark, warc_chunks.write_archives(pages.where("false")))).count() == 0


def test_warc_over_split_files(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * (i % 400) + "\r\n\r\nWARC/1.1\r\n" * (i % 3)) for i in range(1500)], "page_id long, url string, html string").coalesce(1)
    folder = warc_chunks.write_archives(pages, chunk_bytes=500)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10007")
    try:
        found = warc_chunks.records(warc_chunks.read_chunks(spark, folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found) == 1500 and all(r.intact for r in found)


def test_warc_over_buffer_ends(spark, tmp_path):
    made = 0
    for kind, body, refers in (("crlf", b"<p>\r\n", None), ("crlfs", b"<p>\r\n\r\n", None), ("cr", b"<p>\r", None), ("empty", b"", None), ("revisit", b"", 0), ("plain", b"x", None)):
        for shift in range(-20, 21):
            lines = [next(warc_chunks.record_lines(p, p, "u", b, r, 1 << 20)) + b"\r\n\r\n" for p, b, r in ((1, body, refers), (2, b"end", None))]
            # the block of the second record ends ``shift`` bytes from the end of the reader's buffer
            size = 65_536 + shift - (len(lines[0]) - 4)
            least = len(next(warc_chunks.record_lines(0, 0, "u", b"x" * 60_000, None, 1 << 20))) + 4 - 60_000
            first = next(warc_chunks.record_lines(0, 0, "u", b"x" * (size - least), None, 1 << 20)) + b"\r\n\r\n"
            assert len(first) == size
            (tmp_path / f"{kind}{shift}.txt").write_bytes(first + b"".join(lines))
            made += 1
    found = warc_chunks.records(warc_chunks.read_chunks(spark, str(tmp_path))).groupBy("page_id", "intact").count().collect()
    assert {(r.page_id, r.intact): r["count"] for r in found} == {(p, True): made for p in range(3)}


def test_warc_addresses_that_end_like_a_record(spark):
    bodies = ["", "WARC/1.1", "\nWARC/1.1", "WARC/1.1\r\n", "\nWARC/1.1\r\n" * 3]
    pages = spark.createDataFrame([(i, "http://x/WARC/1.1", b) for i, b in enumerate(bodies)], "page_id long, url string, html string").coalesce(1)
    found = warc_chunks.records(warc_chunks.read_chunks(spark, warc_chunks.write_archives(pages))).collect()
    assert {(r.page_id, r.payload_bytes, r.uri) for r in found} == {(i, len(b), "http://x/WARC/1.1") for i, b in enumerate(bodies)} and all(r.intact for r in found)


def test_simhash(odd, none):
    rows = covering_simhash.near_groups(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    kept = covering_simhash.drop_near_copies(odd)
    same_columns(kept, odd)
    assert sorted(((r.doc_id is None, r.doc_id) for r in kept.collect())) == sorted((x is None, x) for x in (1, 4, None, 7, 8))
    assert covering_simhash.near_groups(none).count() == 0 and covering_simhash.drop_near_copies(none).count() == 0


@pytest.mark.parametrize("below", [2, 48])
def test_links_cover_every_close_pair(spark, below):
    import random

    draw = random.Random(5)
    base = draw.getrandbits(64)
    prints = {base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))) for _ in range(250)} | {draw.getrandbits(64) for _ in range(50)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = covering_simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, below)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in found.collect())
    got = {r.node: r.root for r in components.components(found).collect()}
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {p: got.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_masks_cover():
    from itertools import combinations

    for radius in (1, 2):
        masks = covering_simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and all(m.bit_count() > 20 for m in masks)
        assert all(any(not m & sum(1 << b for b in bits) for m in masks) for bits in combinations(range(64), radius))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (3, 2), (3, 2)]
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hierarchical_quality(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 0), (7, None, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = hierarchical_quality.quality_posteriors(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 < r.posterior_quality < 1 and 0 < r.posterior_toxic < 1 for r in rows)
    assert hierarchical_quality.quality_posteriors(none, labels).count() == 0
    assert {round(r.evidence_toxic, 6) for r in hierarchical_quality.quality_posteriors(odd, labels.where("false")).collect()} == {0.5}


def test_sparse_sites_shrink_towards_their_parents(spark):
    rows = [(i, "big", "p", 0.9) for i in range(500)] + [(i, "low", "q", 0.1) for i in range(500)] + [(1000, "tiny", "r", 0.9), (1001, "tiny", "r", 0.9)]
    found = hierarchical_quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence_x double"), "x").collect()
    prior = {r.host: r.prior_x for r in found}
    assert prior["big"] > prior["tiny"] > prior["low"] and abs(prior["big"] - 0.9) < 0.02


def test_fertility(odd, none):
    rows = fertility_rules.quality_verdicts(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_words == 0 and by[2].base_failed and not by[2].kept and by[2].chars_per_token is None and by[2].script == "none"
    assert by[8].word_chars == 300_000 and by[7].n_words == 120_000
    kept = fertility_rules.drop_low_quality(odd)
    same_columns(kept, odd)
    assert fertility_rules.quality_verdicts(none).count() == 0 and fertility_rules.drop_low_quality(none).count() == 0


def test_fertility_bands_reject_odd_texts(spark):
    import random

    draw = random.Random(2)
    plain = ["".join(draw.choice(["ta", "ko", "mi", "ser", "lan"]) for _ in range(3)) for _ in range(400)]
    docs = [(i, " ".join(draw.choice(plain) for _ in range(150)), "xx") for i in range(200)] + [(1000, " ".join("".join(chr(0x13000 + draw.randrange(600)) for _ in range(4)) for _ in range(150)), "xx")]
    rows = {r.doc_id: r for r in fertility_rules.quality_verdicts(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert not rows[1000].kept and not rows[1000].base_failed and rows[1000].fallback_share > 0.5
    assert all(rows[i].kept for i in range(200))


def test_scripts():
    assert [fertility_rules.script_of(t) for t in ("abc", "123", "", "привет abc", "漢字かな漢字", "été")] == ["latin", "none", "none", "cyrillic", "han", "latin"]


def test_token_scan(spark, odd, none):
    for block in (2, 64, 1 << 20):
        rows = separator_scan.token_counts(odd, block_bytes=block).collect() if block > 2 else separator_scan.token_counts(odd.where("length(text) < 100 OR text IS NULL"), block_bytes=block).collect()
        encode = separator_scan.encoding(open(separator_scan.VOCABULARY, "rb").read()).encode_ordinary
        want = sorted((d is None, d, len(encode(t or ""))) for d, t, *_ in ODD if block > 2 or len(t or "") < 100)
        assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in rows) == want
    assert separator_scan.token_counts(none).count() == 0


def test_scan_of_a_file_without_a_last_end(spark, tmp_path):
    import numpy as np

    end = separator_scan.END_OF_DOCUMENT
    np.array([1, 2, end, end, 5, 6, 7], "<u2").tofile(tmp_path / "a.bin")
    np.array([end], "<u2").tofile(tmp_path / "b.bin")
    np.array([3, 4], "<u2").tofile(tmp_path / "c.bin")
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}.bin", b) for n, b in (("a", 14), ("b", 2), ("c", 4))], "file string, bytes long")
    for block in (2, 4, 6, 1024):
        found = {(r.file[-5], r.ordinal, r.start, r.n_tokens) for r in separator_scan.scan(files, block_bytes=block).collect()}
        assert found == {("a", 0, 0, 2), ("a", 1, 3, 0), ("a", 2, 4, 3), ("b", 0, 0, 0), ("c", 0, 0, 2)}


def test_repeats(spark, odd, none):
    rows = sparse_suffix.repeated_passages(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: r.n_repeated for r in rows if r.doc_id != 7} == {1: 0, 2: 0, 3: 0, 4: 0, None: 0, 8: 0}
    cut = sparse_suffix.cut_repeats(odd)
    same_columns(cut, odd)
    assert cut.count() == len(ODD)
    assert sparse_suffix.repeated_passages(none).count() == 0 and sparse_suffix.cut_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_agree_with_brute_force(spark, seed):
    import random

    from tests.llm.test_brute_force import covered, repeats

    draw = random.Random(seed)
    common = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randint(5, 60))) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [draw.choice(common) if draw.random() < 0.5 else " ".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(0, 6))]
        docs.append((i, " ".join(parts)))
    docs += [(200 + i, docs[i][1]) for i in range(40)] + [(300, "same " * 200), (301, "same " * 90)]
    every, later = repeats(docs, 20)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for r in sparse_suffix.repeated_passages(frame, min_words=20, seed_words=4).collect():
        assert covered(r.repeated) == every[r.doc_id] and covered(r.removable) == later[r.doc_id]
    texts = {r.doc_id: r.text for r in sparse_suffix.cut_repeats(frame, min_words=20, seed_words=4).collect()}
    for doc_id, text in docs:
        left = [w for k, w in enumerate(text.split()) if k not in later[doc_id]]
        assert (texts.get(doc_id) or "").split() == left


def test_repeated_rows_are_one_place(spark):
    text = " ".join(f"w{i}" for i in range(80))
    frame = spark.createDataFrame([(1, text), (1, text), (2, "other")], "doc_id long, text string")
    assert {(r.doc_id, r.n_repeated) for r in sparse_suffix.repeated_passages(frame).collect()} == {(1, 0), (2, 0)}


def test_pseudo_likelihood(odd, none):
    rows = pseudo_likelihood.pseudo_likelihoods(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_tokens == 0 and by[2].log_likelihood == 0 and by[2].per_token is None
    assert by[7].n_tokens == 120_000 and by[7].log_likelihood < 0
    assert pseudo_likelihood.pseudo_likelihoods(none).count() == 0


def test_words_of_a_slot_share_its_probability(spark):
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in draw.zipf(1.3, 400) if x < 20_000) for _ in range(60)] + ["rare " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = pseudo_likelihood.vocabulary(docs)
    flat = pseudo_likelihood.train(docs, words)
    counts = collections.Counter(w for t in texts for w in t.encode().split())
    assert len(counts) > len(words.numbers)
    net = pseudo_likelihood.Network(words.counts, flat)
    unseen = [f"z{i}" for i in range(20_000)]
    first = {}
    for w in unseen:
        first.setdefault(int(words.encode([w.encode()])[0]), w)
    slots = len(words.counts) - words.common
    assert len(first) == slots
    asked = [w.decode() for w in counts] + list(first.values())
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(asked)], "doc_id long, text string")
    alone = {asked[r.doc_id]: r.log_likelihood for r in pseudo_likelihood.scored(frame, words, flat).collect()}
    # the words of the corpus and one unseen word a slot have all the probability
    edge = np.full(3, len(words.counts), np.int32)
    of_number = {k: net.log_probabilities(np.concatenate([edge, [k], edge]).astype(np.int32))[0][0] for k in range(len(words.counts))}
    total = collections.Counter(int(words.encode([w])[0]) for w in counts for _ in range(counts[w]))
    for w in asked:
        k = int(words.encode([w.encode()])[0])
        share = 1 if w.encode() in words.numbers else max(1, counts[w.encode()]) / (total[k] + 1)
        assert abs(alone[w] - of_number[k] - math.log(share)) < 1e-3
    assert abs(sum(map(math.exp, alone.values())) - 1) < 0.01


def test_words_and_tails_of_a_whole_column():
    """Split as a column, the words, their numbers and the counts of rare ones are those of each text on its own."""
    draw = random.Random(4)
    letters = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u3000aAbB\u00e9\u00c9\u0130.\U0001f389"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(14))) for _ in range(500)] + [None, "", "  ", " a b "]
    column = pa.array(texts, pa.string())
    words, of = pseudo_likelihood.split_words(column)
    each = [pseudo_likelihood.words_of(t) for t in texts]
    assert list(zip(words.to_pylist(), of.tolist())) == [(w, i) for i, own in enumerate(each) for w in own]
    encoder, tails = pseudo_likelihood.Encoder({b"a": 0, b"b": 1}, 2, 3), []
    [(ids, rows)] = pseudo_likelihood.stretches(column, 5, encoder, tails)
    edge, side = [5] * pseudo_likelihood.SIDE, pseudo_likelihood.SIDE
    assert ids.tolist() == edge + [n for own in each for n in [*encoder.encode(own).tolist(), *edge]]
    assert rows.tolist() == [-1] * side + [n for i, own in enumerate(each) for n in [*[i] * len(own), *[-1] * side]]
    [(tail, times)] = tails
    assert [dict(zip(*pair)) for pair in zip(tail.to_pylist(), times.to_pylist())] == [dict(collections.Counter(w for w in own if w not in (b"a", b"b"))) for own in each]


def test_the_vocabulary_grows_with_the_corpus():
    sides = [pseudo_likelihood.side_of(n) for n in (0, 10**6, 10**8, 10**10)]
    assert sides == sorted(sides) and sides[0] == sides[1] < sides[2] < sides[3]


def test_free_name(spark):
    assert shared.free_name(spark.range(1).toDF("Row"), "row") == "_row"


def test_queries_need_no_pipeline_folder():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
