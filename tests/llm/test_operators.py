"""Each operator against a plain restatement, on odd rows and on a driver table."""

import hashlib
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from paroxys.llm import chat, components, decontaminate, exact_dedup, katz, language, mixing, simhash, suffix, surrogates, warc
from paroxys.llm.common import crc32_of, fresh, table
from paroxys.session import shared_folder

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.fixture(scope="module", params=["odd", "none", "driver"])
def docs(request, spark, odd_docs, no_docs):
    return {"odd": odd_docs, "none": no_docs}.get(request.param) or table(spark, SF, "documents")


# --- exact dedup ------------------------------------------------------------------------


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 12])
def test_exact_dedup(docs, max_bits):
    """A filter far too small lets more rows shuffle and changes nothing else."""
    rows = exact_dedup.report(docs, bits_per_row=1, max_bits=max_bits)
    same([tuple(r) for r in rows.collect()], brute.exact(pairs(docs)))


def test_exact_dedup_keeps_one_row_and_all_columns(odd_docs):
    kept = exact_dedup.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=brute.order) == [3, 7, 10, 11, 12, 13, 14, 14, None]


def test_bloom_filter_never_misses_a_repeat(spark):
    hashes = spark.range(2000).select((F.col("id") % 1900).alias("h")).select(F.xxhash64("h").alias("h"))
    found = exact_dedup.repeated_filter(hashes, 64)
    rows = spark.range(1900).select(F.col("id").alias("sha")).select(F.xxhash64("sha").alias("own"), "sha")
    flagged, flag = exact_dedup._possible(rows.drop("own"), "sha", found, 64)
    ids = {r.sha for r in flagged.where(flag).collect()}
    assert set(range(100)) <= ids and len(ids) < 400


# --- repeated passages ------------------------------------------------------------------


@pytest.mark.parametrize("bucket_bytes", [12 << 20, 4000])
def test_repeats(docs, bucket_bytes):
    got = suffix.remove_repeats(docs, bucket_bytes=bucket_bytes)
    same([tuple(r) for r in got.collect()], brute.repeats(pairs(docs)))


def test_repeats_across_pieces_and_periods(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 300)
    run = "abcabc " * 200
    rows = [(1, run), (2, "x" * 80 + run[:777]), (3, run + "tail that is new"), (4, "y" * 49), (5, "x" * 90)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    same([tuple(r) for r in suffix.remove_repeats(docs, bucket_bytes=2000).collect()], brute.repeats(rows))


def test_repeats_return_the_remaining_bytes(spark):
    a = "A passage of more than fifty bytes that two documents have in common."
    docs = spark.createDataFrame([(1, a), (2, f"before {a} after")], "doc_id bigint, text string")
    kept = {r.doc_id: bytes(r.kept) for r in suffix.remove_repeats(docs, keep_text=True).collect()}
    assert kept == {1: a.encode(), 2: b"before  after"}


def test_multikey_order_and_groups():
    rng = np.random.default_rng(3)
    text = bytes(rng.choice(list(b"ab"), 4000)) + b"z" * 200
    buffer = np.frombuffer(text * 2, np.uint8)
    at = np.arange(len(buffer) - 60)
    order, heads = suffix.multikey_groups(buffer, at)
    heads_of = [buffer[i : i + 50].tobytes() for i in at[order].tolist()]
    assert heads_of == sorted(heads_of)
    want = [0, *(i for i in range(1, len(heads_of)) if heads_of[i] != heads_of[i - 1])]
    assert heads.tolist() == want


def test_splitters_spread_a_hot_token():
    lead = np.array([5, 5, 5, 5, 7, 7, 9], np.uint64)
    doc = np.array([1, 10, 20, 30, 1, 5, 2])
    splitters = (np.array([5, 5, 7, 7], np.uint64), np.array([10, 20, 3, 4]))
    assert suffix._bucket_of(lead, doc, splitters).tolist() == [0, 1, 2, 2, 2, 4, 4]


# --- mixing -----------------------------------------------------------------------------


def domain(_=None):
    return F.when(F.col("source").startswith("src"), "web")


def test_mixing_respects_budgets_and_epochs(odd_docs, no_docs):
    rows, names = mixing.mix(odd_docs, domain(), {"lang": {"en": 3}}, budget_share=0.6, max_epochs=2)
    got = rows.collect()
    tokens = sum(len(brute.words(t)) for _, t in pairs(odd_docs))
    assert sum(r[names["tokens"]] for r in got) <= 0.6 * tokens
    assert max(r[names["epoch"]] for r in got) <= 1
    assert rows.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert mixing.mix(no_docs, domain(), {})[0].count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", "s", 10), ("a", "y", "s", 1000), ("b", "x", "s", 1000)],
        "domain string, lang string, source string, tokens bigint",
    )
    rows = mixing.leaf_budgets(leaves, F.lit(400).cast("bigint"), {}, 1).collect()
    assert {(r.domain, r.lang): r.budget for r in rows} == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}
    # A subtree that is full passes the rest to its ancestors' other children.
    rows = mixing.leaf_budgets(leaves, F.lit(2005).cast("bigint"), {}, 1).collect()
    assert {(r.domain, r.lang): r.budget for r in rows} == {("a", "x"): 10, ("a", "y"): 992, ("b", "x"): 1000} or sum(
        r.budget for r in rows
    ) in (2004, 2005)


def test_mixing_repeats_whole_epochs_then_a_prefix(spark):
    docs = spark.createDataFrame(
        [(i, "one two three four", "en", "src1") for i in range(50)], "doc_id bigint, text string, lang string, source string"
    )
    rows, names = mixing.mix(docs, domain(), {}, budget_share=2.5, max_epochs=4)
    counts = {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert sorted(set(counts.values())) == [2, 3] and sum(counts.values()) == 125
    again = {tuple(r) for r in mixing.mix(docs.repartition(7), domain(), {}, 2.5, 4)[0].collect()}
    assert again == {tuple(r) for r in rows.collect()}


def test_weights_must_be_positive(odd_docs):
    with pytest.raises(ValueError):
        mixing.mix(odd_docs, domain(), {"lang": {"en": 0}})


# --- WARC -------------------------------------------------------------------------------


PAGES = "page_id bigint, url string, html string, digest string, length int"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "é" * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n</p>"
    rows = [
        (4, "http://a/", big, "x", 1),
        (2, "http://b/\r\nX: y", big, None, None),
        (None, None, big, None, None),
        (2, "http://b/", big, "x", 1),
        (6, None, "short", "x", 1),
        (7, "", "short", "x", 1),
        (8, "http://c/", None, "x", 1),
        (9, "http://c/", "", "x", 1),
        (1, "http://d/", "z" * 99, "x", 1),
        (3, "http://d/", "z" * 99, "x", 1),
        (11, "http://d/", "z" * 100 + "\r\n\r\n", "x", 1),
        (12, "http://d/", "z" * 100 + "\r\n\r\n", "x", 1),
    ]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_warc_round_trip(spark, pages):
    got = warc.round_trip(pages).collect()
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    want = []
    for page_id, body in rows:
        first = min((i for i, b in rows if b == body), key=brute.order)
        revisit = len(body) >= 100 and page_id != first
        kind = "revisit" if revisit else "response"
        want.append((page_id, len(body), hashlib.sha256(body).hexdigest(), kind, first if revisit else None))
    same([tuple(r) for r in got], want)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_archive_gives_back_every_payload(spark, pages):
    folder = shared_folder(spark, "warc-test")
    archive = warc.write_archive(pages, folder)
    records = warc.read_archive(spark, folder, archive)
    back = warc.archived_pages(records, with_block=True)
    kind = F.col("page_id").cast("bigint")
    same(
        [tuple(r) for r in back.select(kind, "payload").collect()],
        [(r.page_id, r.html or "") for r in pages.collect()],
    )
    one = records.where("page_id = '2'").first()
    assert one.url == "http://b/ X: y" or one.url == "http://b/"


def test_damaged_archive_fails(spark, pages):
    folder = shared_folder(spark, "warc-bad")
    archive = warc.write_archive(pages, folder)
    lines = spark.read.text(folder, wholetext=True).select(F.replace("value", F.lit("zzz"), F.lit("zz")).alias("value"))
    bad = shared_folder(spark, "warc-bad")
    lines.write.text(bad, lineSep="\n")
    with pytest.raises(Exception, match="broken record"):
        warc.read_archive(spark, bad, archive).collect()


# --- language model ---------------------------------------------------------------------


@pytest.mark.parametrize("blocks", [(1 << 21, 1 << 20), (40, 60)])
def test_katz(docs, blocks):
    rows = docs.select("doc_id", "text", "n_chars").collect()
    by_text = F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(7)) != 2
    got, model = katz.fit_and_score(docs, by_text, block_tokens=blocks[0], bucket_triples=blocks[1])
    trained = [zlib.crc32((r.text or "").encode()) % 7 != 2 for r in rows]
    want, n, v, sums = brute.katz([(r.doc_id, r.text) for r in rows], trained, katz.discounts)
    assert (model["n"], model["v"]) == (n, v)
    assert all(abs(s - 1) < 1e-9 for s in sums.values())
    shape = lambda rs: sorted((repr(r[0]), *r[1:3], round(r[3], 4), round(r[4], 4)) for r in rs)
    assert shape([(r.doc_id, r.n_tokens, r.n_known, r.base, r.score) for r in got.collect()]) == shape(want)


def test_katz_without_training_rows(odd_docs):
    got, model = katz.fit_and_score(odd_docs, F.lit(False))
    assert model["n"] == 0 and {r.score for r in got.collect()} == {0.0}


def test_katz_keeps_the_bigrams(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a c")], "doc_id bigint, text string")
    _, model = katz.fit_and_score(docs, F.lit(True), keep_bigrams=True)
    counts = [c for r in model["tables"].where("bigrams is not null").collect() for c in katz.unpack(bytes(r.bigrams))[2]]
    assert sorted(counts) == [1, 1, 1, 1, 2, 2]  # ba, b end, ac, c end; begin a, ab


def test_good_turing_discounts():
    d = katz.discounts({1: 1000, 2: 400, 3: 220, 4: 140, 5: 100, 6: 75})
    cut = 6 * 75 / 1000
    assert abs(d[1] - ((2 * 400 / 1000 - cut) / (1 - cut))) < 1e-12
    assert d[6] == katz.KEPT and all(0 < x < 1 for x in d[1:])
    assert katz.discounts({1: 3})[1] == 0.5


# --- surrogates -------------------------------------------------------------------------


def test_surrogates_keep_type_gender_script_and_reference(spark):
    rows = [
        (1, "Mail Anna.K@Mail.example.com, again anna.k@mail.example.com"),
        (2, "+1 (017) 555-7713 and 1-017-555-7713"),
        (None, "Mrs Smith and Anna SMITH met Иван Петров at 97.51.17.173."),
        (3, None),
        (4, "card 4111 1111 1111 1111, token 0a1b2c3d4e5f60718293"),
        (4, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.n_entities): r.text for r in surrogates.replace(docs, b"k").collect()}
    first = got[1, 2]
    a, b = first.removeprefix("Mail ").split(", again ")
    assert a.lower() == b.lower() and a.endswith(".com") and "anna" not in b
    x, y = got[2, 2].split(" and ")
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert digits(x) == digits(y) != "10175557713" and x.startswith("+1 (") and y[1] == "-"
    name = got[None, 6]
    assert name.startswith("Mrs ") and name.split()[1].lower() == name.split()[4].lower()
    assert name.split()[3] in surrogates.FIRST_NAMES["latin f"] and name.split()[3] != "Anna"
    assert name.split()[6] in surrogates.FIRST_NAMES["cyrillic m"] and name.split()[4].isupper()
    card = next(t for (i, n), t in got.items() if i == 4 and n == 1)
    assert surrogates._luhn(digits(card.split(",")[0])) == 0 and card.endswith("token 0a1b2c3d4e5f60718293")
    assert got[3, 0] is None and got[4, 0] == ""


def test_surrogates_collide_with_nothing(spark):
    rows = [("ip", f"{a}.{b}.1.1", 1) for a in range(1, 10) for b in range(1, 10)]
    rows += [("email", f"{a}@b.com", 1) for a in "abcdefghij"] + [("first name", n, 1) for n in surrogates.FIRST_NAMES["latin m"]]
    entities = spark.createDataFrame(rows, "kind string, canonical string, n int")
    got = surrogates.assign(entities, b"k").collect()
    assert len({(r.kind, r.new) for r in got}) == len(got) == len(rows)
    real = {r[:2] for r in rows if r[0] != "first name"}
    assert not real & {(r.kind, r.new) for r in got}
    assert all(r.new != r.canonical for r in got)


def test_surrogates_on_odd_rows(odd_docs, no_docs):
    got = surrogates.replace(odd_docs, b"k")
    assert got.count() == odd_docs.count() and surrogates.replace(no_docs, b"k").count() == 0


# --- SimHash ----------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [simhash.RUN_LIMIT, 2])
def test_simhash(docs, limit):
    """With a limit of two, keys are split down to the last level."""
    got = simhash.near_classes(docs, run_limit=limit)
    same([tuple(r) for r in got.collect()], brute.simhash(pairs(docs)))


def test_links_within_one_hot_key(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(2**62))
    fps = {base}
    for _ in range(300):
        x = base
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp bigint"), run_limit=20)
    got = brute.roots(range(len(fps)), [])
    place = {s[0]: i for i, s in enumerate(signed)}
    rows = links.collect()
    got = brute.roots(range(len(fps)), [(place[r.a], place[r.b]) for r in rows])
    want = brute.roots(
        range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    )
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    rows = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_texts_keep_one(docs):
    rows = pairs(docs)
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.select("doc_id").collect()]
    assert set(got) == brute.near_kept(rows)


def test_tree_links_a_large_group(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        ws = list(base)
        ws[i * 3] = f"new{i}"
        rows.append((i, " ".join(ws)))
    rows += [(100 + i, " ".join(f"other{i}x{j}" for j in range(40))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.drop_near(docs).collect()} == {0, 100, 101, 102, 103, 104}


def test_near_texts_with_one_contiguous_difference(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        n = int(rng.choice([40, 200, 1000]))
        base = [f"w{min(int(x), 30000)}" for x in rng.zipf(1.3, n)]
        block = [f"w{min(int(x), 30000)}" for x in rng.zipf(1.3, n // 5)]
        cut = int(rng.integers(0, n))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:cut], *block, *base[cut:]]))]
        if i % 3 == 0:
            rows[-1] = (2 * i + 1, " ".join(base + block))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [r.doc_id for r in simhash.drop_near(docs).select("doc_id").collect()]
    want = brute.near_kept(rows)
    assert len(want) < len(rows) and set(got) == want and len(got) == len(want)


def test_copies_of_one_text_that_are_not_near_each_other(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(200):
        ws = list(base)
        for at in rng.choice(200, 4, replace=False):
            ws[at] = f"new{i}x{at}"
        rows.append((i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute.near_kept(rows)
    assert len(want) < 50
    for limit in (16, 1024):
        assert {r.doc_id for r in simhash.drop_near(docs, run_limit=limit).collect()} == want
    # No text, or some, are short enough to be verified where they meet.
    for most in (0, 196):
        assert {r.doc_id for r in simhash.drop_near(docs, first_shingles=most).collect()} == want


def test_parts_hand_out_verified_links_only(spark):
    """Rows out of the kernel of one key stay below its members, and twice as many copies
    give at most 2.2 times as many; the groups are those of all similar pairs."""
    made = []
    for n in (60, 120, 240):
        rng = np.random.default_rng(3)
        texts = []
        for i in range(n):
            ws = [f"w{j}" for j in range(90)]
            for at in rng.choice(90, int(rng.integers(1, 4)), replace=False):
                ws[at] = f"new{i}x{at}"
            texts.append(" ".join(ws))
        sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
        sig = [simhash._parity(g).tolist() for g in sets]
        parts = spark.createDataFrame([(0, i, i) for i in range(n)], "key bigint, node bigint, root bigint")
        sigs = spark.createDataFrame(
            [(i, len(sets[i]), sig[i]) for i in range(n)], "node bigint, size bigint, sig array<bigint>"
        )
        bodies = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
        got = [(r.a, r.b) for r in simhash.verified_parts(parts, sigs, bodies, 5, 0.8).collect()]
        every = [(a, b) for a in range(n) for b in range(a) if simhash._alike(sets[a], sets[b], 0.8)]
        assert set(got) <= set(every) and len(got) < n
        one = lambda x: len({*_roots(n, *zip(*x))})
        assert one(got) == one(every) > 1
        made.append(len(got))
    assert made[1] <= 2.2 * made[0] and made[2] <= 2.2 * made[1]


def test_texts_move_only_to_members_with_a_possible_pair(spark):
    """Unlike texts that share a key stay out; every member of a similar pair stays in."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        ws = [f"own{i}x{j}" for j in range(120)]
        rows.append((0, 2 * i, " ".join(ws)))
        if i % 4 == 0:
            ws[int(rng.integers(0, 120))] = f"new{i}"
            rows.append((0, 2 * i + 1, " ".join(ws)))
    sets = {node: np.unique(simhash.shingle_hashes(t.encode(), 5)) for _, node, t in rows}
    sigs = spark.createDataFrame(
        [(n, len(g), simhash._parity(g).tolist()) for n, g in sets.items()], "node bigint, size bigint, sig array<bigint>"
    )
    # The same pairs under another key have one root already.
    members = [(0, n, n) for n in sets] + [(1, n, n // 2) for n in sets if n % 8 < 2]
    parts = spark.createDataFrame(members, "key bigint, node bigint, root bigint")
    got = [tuple(r) for r in simhash.open_parts(parts, sigs, 0.8).collect()]
    assert sorted(got) == [(0, n, n) for n in sorted(sets) if n % 8 < 2]


def test_near_texts_and_keys_of_one_text_are_not_stored(spark, monkeypatch):
    """Texts with one passage in common, not near each other, leave neither texts nor an index of all keys."""
    common = " ".join(f"c{j}" for j in range(30))
    rows = [(i, common + " " + " ".join(f"own{i}x{j}" for j in range(90))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    stored, write = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, purpose: stored.append((purpose, write(df, purpose))) or stored[-1][1])
    assert simhash.drop_near(docs).count() == len(rows)
    assert not [purpose for purpose, df in stored if "text" in df.columns]
    every = sum(len(r["keys"]) for r in dict(stored)["nodes"].select("keys").collect())
    most = max(df.count() for _, df in stored if {"node", "key"} <= set(df.columns))
    assert most < every / 2


def test_pairs_that_span_grow_with_the_members():
    """Of borderline copies under one key a part hands on less than its members; twice as
    many copies give at most 2.2 times as many pairs."""
    rows = []
    for n in (300, 600, 1200):
        rng = np.random.default_rng(1)
        grams = np.unique(rng.integers(0, 2**63, 80).astype(np.uint64))
        sets = [np.unique(np.where(rng.random(80) < 0.07, rng.integers(0, 2**63, 80).astype(np.uint64), grams)) for _ in range(n)]
        sets.sort(key=len)
        sig = np.stack([simhash._parity(g).view(np.uint64) for g in sets])
        size, root = np.array([len(g) for g in sets]), np.arange(n)
        key = np.zeros(n, np.int64)
        a, b = simhash._meetings(key, size, root, sig, 0.8, True)
        every, _ = simhash._meetings(key, size, root, sig, 0.8, False)
        assert len(a) < n and len(every) > len(a)
        # The same groups as all pairs together.
        joined = lambda x, y: len({*map(int, _roots(n, x, y))})
        full = simhash._meetings(key, size, root, sig, 0.8, False)
        assert joined(a, b) == joined(*full)
        rows.append(len(a))
    assert rows[1] <= 2.2 * rows[0] and rows[2] <= 2.2 * rows[1]


def _roots(n, a, b):
    root = np.arange(n)
    for x, y in zip(a, b):
        root[root == root[x]] = root[y]
    return root


def test_blocks_of_a_large_key_are_bounded_and_meet(spark):
    rows = [(k, i, 7 if i < 300 else i) for k in (1, 2) for i in range(400)] + [(3, 1, 7), (3, 2, 7)]
    live = spark.createDataFrame(rows, "key bigint, node bigint, root bigint")
    parts = {}
    for r in simhash._spread(live, 20).collect():
        parts.setdefault(r.part, []).append((r.node, r.root))
    assert max(map(len, parts.values())) <= 100
    met = {(a, b) for p in parts.values() for a, x in p for b, y in p if x != y}
    assert met == {(a, b) for a in range(400) for b in range(400) if a != b and max(a, b) >= 300}


@pytest.mark.parametrize("n", [3000, 6000])
def test_bitmaps_never_rule_out_a_near_text(n):
    rng = np.random.default_rng(n)
    x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    y = np.unique(np.concatenate([x[: n * 9 // 10], rng.integers(0, 2**63, n // 5).astype(np.uint64)]))
    apart = len(np.setxor1d(x, y))
    assert simhash._wide_apart(simhash._wide_parity(x), simhash._wide_parity(y)) <= apart
    other = rng.integers(0, 2**63, n).astype(np.uint64)
    assert simhash._wide_apart(simhash._wide_parity(x), simhash._wide_parity(other)) > 2 * n / 9


# --- chat -------------------------------------------------------------------------------


TURNS = "conv_id bigint, turn bigint, role string, text string, place string, n int"


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "be kind", "x", 1),
        (1, 1, "ann", "hello", "x", 1),
        (1, 2, "bob", None, "x", 1),
        (1, 2, "bob", None, "x", 1),
        (1, None, None, "early", None, None),
        (2, 0, "system", "alone", "x", 1),
        (None, 5000, "ann", "far", "x", 1),
        (None, 1, "bob", "near", "x", 1),
    ]
    got = chat.rotate(spark.createDataFrame(rows, TURNS))
    seen = {(r.conv_id, r.perspective) for r in got.collect()}
    assert seen == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (None, "bob")}
    whole = {(r.conv_id, r.perspective): r for r in chat.dialogues(got).collect()}
    ann = whole[1, "ann"]
    assert ann.text == (
        "<|im_start|>user name=unknown\nearly<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n"
        "<|im_start|>assistant\nhello<|im_end|>\n" + "<|im_start|>user name=bob\n<|im_end|>\n" * 2
    )
    assert [ann.text[s.start : s.end] for s in ann.learned] == ["hello<|im_end|>\n"]
    far = whole[None, "ann"]
    assert [far.text[s.start : s.end] for s in far.learned] == ["far<|im_end|>\n"]
    assert chat.rotate(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_runs_no_python(spark):
    plan = chat.rotate(table(spark, SF, "conversations"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- language ---------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    held_out = F.pmod(crc32_of("doc_id"), F.lit(4)) == 2
    model = language.fit(docs.where(~held_out))
    rows, names = language.predict(docs, model)
    right = rows.where(held_out).agg(F.avg((F.col(names["lang"]) == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.98
    bounds = rows.agg(F.min(names["score"]), F.max(names["score"])).first()
    assert 0 <= bounds[0] and bounds[1] <= 1


def test_language_of_odd_rows(odd_docs, no_docs):
    model = language.fit(odd_docs)
    rows, names = language.predict(odd_docs, model)
    got = [(r.doc_id, r[names["lang"]]) for r in rows.collect()]
    assert {(7, "und"), (8, "und"), (10, "und"), (11, "und")} <= set(got)
    assert all(name in ("de", "en", "fr", "und") for _, name in got)
    nothing = language.fit(no_docs)
    rows, names = language.predict(odd_docs, nothing)
    assert {r[names["lang"]] for r in rows.collect()} == {"und"}
    assert language.predict(no_docs, model)[0].count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 20])
def test_codewords_are_apart_and_split_every_bit(n):
    code = language.codewords(n)
    assert all(-n < s < n for s in code.sum(axis=0))
    apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert apart >= {2: 1, 3: 2}.get(n, 4)


def test_decoding_corrects_a_wrong_bit_and_flags_doubt():
    code = language.codewords(4)
    model = language.Model(list("abcd"), code, np.zeros((language.DIMS, 7)), np.ones(7))
    margins = code[2].astype(float)
    margins[0] *= -0.5
    assert model.decode(margins)[0] == "c"
    assert model.decode(np.zeros(7))[2]


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = "Über alles ".encode() * 500
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "SLICE", 97)
    assert (language.gram_counts(text) == whole).all()


# --- decontamination --------------------------------------------------------------------


ITEMS = "item_id bigint, text string, words string"


@pytest.mark.parametrize("block", [1_000_000, 3])
def test_decontamination(spark, docs, block):
    ten = "quick brown fox jumps over the lazy dog while seven wizards"
    items = [(1, ten), (20, "Seven wizards"), (3, "straße STRASSE"), (None, "same id"), (3, "straße"), (5, None), (6, "!!!"), (7, "word5 xxxxx word6 xxxxxx")]
    bench = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    got = decontaminate.report(docs, bench, block_windows=block).drop("word_spans")
    same([tuple(r) for r in got.collect()], brute.contamination(pairs(docs), items))


def test_decontamination_cuts_or_drops(spark, odd_docs):
    bench = spark.createDataFrame([(1, "quick brown fox"), (2, "mill POND")], "item_id bigint, text string")
    cut = decontaminate.decontaminate(odd_docs, bench, action="cut")
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    row = cut.where("doc_id = 5").first()
    assert row.text == "The  jumps over the lazy dog while seven wizards brew odd potions near the old "
    left = [r.doc_id for r in decontaminate.decontaminate(odd_docs, bench).collect()]
    assert 5 not in left and 12 in left and left.count(14) == 2
    none = bench.limit(0)
    assert decontaminate.decontaminate(odd_docs, none).count() == odd_docs.count()


def test_fresh_names_avoid_any_case(odd_docs):
    assert fresh(odd_docs, "Epoch", "epoch", "x") == ["__Epoch", "___epoch", "_x"]
