"""Each operator against brute force, and on awkward tables: nulls, empty and long texts, ties, repeated rows, none, other columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from attesta.llm import decision_list, exact_dedup, jaccard, langid, licences, mixing, packing, quality, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("aeilnorst"), r.integers(2, 8))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    base = prose(1, 300)
    near = base.split()
    near[100] = "changed"
    texts = [base, base, base.replace(" ", "  ", 3), " ".join(near), prose(2, 80), None, "", "   ", None, "one two", "One TWO", "x", prose(3, 20_000), "é日\U0001f600 " * 50, "Released under the MIT License.\nsome text", prose(4, 120), prose(5, 60)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None, "c")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, base, "en", "a", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def odd(docs):
    """Columns that clash with what operators add or use, and with each other but for case."""
    extra = ["kept", "score", "row", "k", "size", "copies", "digest", "n", "shard", "block", "node", "component", "TEXT", "Doc_Id", "held_out", "target"]
    return docs.select("*", *(docs.n_chars.alias(x) for x in extra))


def labels(spark, n=17):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(n)] + [(None, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int")


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def runs(spark):
    return {
        "pack": lambda d: packing.harmonic_pack(d),
        "licences": lambda d: licences.scan(d),
        "shard": lambda d: sharding.shard_documents(d),
        "quality": lambda d: quality.classify(d),
        "toxicity": lambda d: toxicity.toxicity(d, labels(spark)),
        "rules": lambda d: decision_list.quality_rules(d, labels(spark)),
        "dedup": lambda d: exact_dedup.exact_dedup(d),
        "mix": lambda d: mixing.entropy_mix(d),
        "jaccard": lambda d: jaccard.jaccard_components(d),
        "langid": lambda d: langid.language_id(d),
    }


NAMES = ["pack", "licences", "shard", "quality", "toxicity", "rules", "dedup", "mix", "jaccard", "langid"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert runs(spark)[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_other_columns_change_nothing(spark, docs, odd, name):
    f = runs(spark)[name]
    plain, other = rows_of(f(docs)), rows_of(f(odd))
    assert len(plain) >= len(awkward_rows())
    if name not in ("pack", "shard"):  # their places may differ by partitions, tested below
        assert plain == other
    else:
        assert len(plain) == len(other)


def test_pack_is_an_exact_round_trip(docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = packing.harmonic_pack(docs).toPandas()
    ids = {}
    for r in awkward_rows():
        a = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        ids.setdefault(r[0], []).append(a)
    for r in got.itertuples():
        piece = slice(int(r.start), int(r.start + r.length))
        assert any(len(a) == r.doc_tokens and zlib.crc32(a[piece].tobytes()) == r.ids_crc32 for a in ids[None if pd.isna(r.doc_id) else int(r.doc_id)])
    assert got.length.sum() == sum(len(a) for many in ids.values() for a in many)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024
    sequences = got.groupby("sequence_id").length.sum()
    assert (sequences < 1024 - 16).sum() <= 1  # full but for the remainder of a length, and one sequence of a pool


def test_ids_of_added_tokens_and_long_white_space():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.Encoder(path("byte_bpe_50k.json"))
    ids = lambda text: np.frombuffer(encode(text), "<u4").tolist()
    assert ids("a<|endoftext|>b") == [64, 50256, 65]
    spaces = [f"a{c * n}b{end}" for c, n in ((" ", 49_999), (" ", 50_001), ("\n", 60_000), (" ", 1_100_000)) for end in ("", " c")]
    for text in ["", "<|endoftext|>", " <|endoftext|>  x <|endoftext|><|endoftext|>\n", "<|endoftext|", *spaces, " " * 1_100_000]:
        assert ids(text) == t.encode(text, add_special_tokens=False).ids


def test_bins_hold_as_many_rests_as_their_class():
    """Rests of a class fill a bin whole; later ones go into what it leaves, and are cut only when many bins wait."""
    ids = lambda n: b"\0" * (4 * n)
    sizes = [40, 45, 40, 40, 30, 30, 30, 15, 12]
    for waiting, done, gaps in ((3, [[0, 1, 7]], [8, 10]), (2, [], [5, 10, 3])):
        bins = packing.Bins(100, waiting)
        assert [[p[0] for p in b] for i, n in enumerate(sizes) for b in bins.add(i, 0, ids(n), n)] == done
        assert bins.gaps == sorted(gaps)
    r = np.random.default_rng(8)
    bins, sizes = packing.Bins(1024), r.integers(1, 1024, 3000).tolist()
    full = [b for i, n in enumerate(sizes) for b in bins.add(i, 0, ids(n), n)]
    assert all(sum(len(p[2]) for p in b) == 4096 for b in full)
    pieces = [p for b in full for p in b] + bins.left()
    assert sum(len(p[2]) for p in pieces) == 4 * sum(sizes) and len(bins.gaps) <= packing.WAITING + 1
    by_doc = Counter(p[0] for p in pieces)
    assert len(by_doc) == 3000 and sum(n > 1 for n in by_doc.values()) < 0.5 * 3000


def test_licence_rules(spark):
    full = "# Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, full), (2, "Text. Licensed under CC BY-NC 4.0. More.\nReleased under the MIT Licence"), (3, "a licence that nobody knows of"), (4, None)]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit-grant,mit-notice", "MIT"), 2: ("cc-by-nc,mit-short", "MIT,CC-BY-NC-4.0"), 3: ("", ""), 4: ("", "")}


def test_licences_wrapped_over_lines(spark):
    import textwrap

    say = {k: licences.SENTENCES[k][0] for k in licences.SENTENCES}
    texts = {
        "MIT": ["MIT License. Copyright (c) 2020 A", say["mit-grant"], say["mit-notice"] + ".", say["as-is"] + ".", say["liability"] + "."],
        "BSD-3-Clause": [say["bsd-head"], "1. " + say["bsd-source"] + ".", "2. " + say["bsd-binary"] + ".", "3. " + say["bsd-endorse"] + "."],
        "ISC": ["Copyright 2020 A", say["isc-grant"] + "."],
        "GPL-3.0-or-later": [say["gpl-grant"] + ". " + say["gpl-hope"] + ". " + say["gpl-see"].capitalize() + "."],
    }
    rows, want = [], {}
    for name, parts in texts.items():
        for width in (40, 70, 78, 2_000):
            for first, mark, last in (("", "", ""), ("/*\n", " * ", "\n */"), ("", "# ", ""), ("", "// ", ""), ("", "    ", "")):
                for gap in ("\n", "\n" + mark.rstrip() + "\n"):
                    lines = [textwrap.indent(textwrap.fill(x, width, break_on_hyphens=False), mark) for x in parts]
                    for end in ("\n", "\r\n"):
                        rows.append((len(rows), ("int x;\n" + first + gap.join(lines) + last + "\nint y;").replace("\n", end)))
                        want[rows[-1][0]] = name
    padded = "Released under " + " " * 700 + "the MIT License"
    none = ["Released under the\n\nMIT License", "Not released under the\nMIT License", "Released under the\nMIT License or another", " " * 300_000 + "x" + "*" * 300_000 + "/" * 300_000]
    for text, name in [(padded, "MIT"), ("Text\nReleased under the\nMIT License\nmore", "MIT"), *((x, "") for x in none)]:
        rows.append((len(rows), text))
        want[rows[-1][0]] = name
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [rows[i] for i in got if got[i] != want[i]] == []


def test_shards_are_even_and_keep_groups(spark, docs):
    got = sharding.shard_documents(docs, 5).toPandas()
    counts = got.groupby("shard").size().reindex(range(5), fill_value=0)
    assert counts.max() - counts.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    many = spark.createDataFrame([(i, f"text {i // 4}" if i < 400 else f"single {i}" if i < 700 else "hot") for i in range(1000)], "doc_id long, text string")
    got = sharding.shard_documents(many, 8).toPandas().merge(many.toPandas(), on="doc_id")
    counts = got.groupby("shard").size()
    assert counts.tolist() == [125] * 8
    per = got[got.doc_id < 400].groupby("text").shard.nunique()
    assert (per > 1).mean() < 0.1  # scattered at random nearly all would be
    assert got[got.text == "hot"].groupby("shard").size().max() >= 25


def test_large_groups_stay_whole_while_a_shard_can_hold_them(spark):
    sizes = [90, 80, 70, 60, 45, 30, 30, 26, 250]  # 8 shards of 120 rows; only the last group exceeds one
    texts = [f"group {i}" for i, n in enumerate(sizes) for _ in range(n)]
    texts += [f"pair {i // 2}" for i in range(100)] + [f"alone {i}" for i in range(960 - len(texts) - 100)]
    many = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sharding.shard_documents(many, 8).toPandas().merge(many.toPandas(), on="doc_id")
    assert (got.groupby("shard").size() == 120).all()
    per = got[got.text.str.startswith("group")].groupby("text").shard.nunique()
    assert per.drop("group 8").max() == 1 and per["group 8"] == 3


def test_placing_large_groups():
    places, room = sharding.place([[5, 5], [3, 3, 3, 3, 3], [4]], 3, 12)
    assert places[0] in ([s, s] for s in range(3)) and len({*places[1]}) == 2 and sum(room) == 7
    places, room = sharding.place([[4, 4, 4]], 2, 5)  # a block that fits nowhere is placed all the same
    assert sum(room) == -2 and {*places[0]} == {0, 1}


def test_exact_dedup_against_brute_force(docs):
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect())
    groups = {}
    for r in awkward_rows():
        groups.setdefault(SPACES.sub(" ", r[1] or ""), []).append(r[0])
    want = Counter()
    for ids in groups.values():
        ids.sort(key=lambda x: (x is None, x))
        for i, x in enumerate(ids):
            want[x, ids[0], len(ids), i == 0] += 1
    assert got == want


@pytest.mark.parametrize("fan_in,entries", [(2, 1), (3, 2), (8, 500_000)])
def test_tree_merge_at_any_depth(docs, fan_in, entries):
    base = exact_dedup.digests(docs).persist()
    got = exact_dedup.groups(base, fan_in, entries).collect()
    assert sorted(r.n for r in got) == sorted(r["count"] for r in base.groupBy("digest").count().collect())


def test_keep_first_keeps_one_of_each_text(docs):
    kept = exact_dedup.keep_first(docs).collect()
    texts = Counter(SPACES.sub(" ", r.text or "") for r in kept)
    assert set(texts.values()) == {1} and len(texts) == len({SPACES.sub(" ", r[1] or "") for r in awkward_rows()})
    assert min(r.doc_id for r in kept if r.doc_id is not None) == 0


def filled(sizes: dict, total: float, weights) -> dict:
    target, open_ = {}, set(sizes)
    while True:
        left, w = total - sum(target.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > 2 * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= set(over)


def test_mix_meets_its_targets(spark):
    r = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(min(3000, r.pareto(1.1) * 20 + 1))), ["s%02d" % (i % 9), None, "hot"][0 if i % 3 else 1 + i % 2]) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.entropy_mix(d).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "source"]), on="doc_id")
    got["words"] = got.text.map(lambda t: len(WORD.findall(t)))
    got["source"] = got.source.where(got.source.notna(), "~null")
    assert (got["size"] == got.words).all() and (got.taken <= 2 * got.words).all() and (got.taken == got.copies * got["size"]).all()
    sizes = got.groupby("source").words.sum().to_dict()
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = filled(sizes, 1.5 * sum(sizes.values()), weights)
    for s, g in got.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(want[s]) and abs(g.taken.sum() - want[s]) <= max(5, 0.005 * want[s])
    again = mixing.entropy_mix(d).toPandas().set_index("doc_id").taken
    assert (got.set_index("doc_id").taken == again).all()


def test_mix_repeats_rows(docs):
    copies = mixing.entropy_mix(docs).agg({"copies": "sum"}).first()[0]
    taken = mixing.take_copies(docs)
    assert taken.columns == docs.columns and abs(taken.count() - copies) <= 2


def shingles(text, k):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    low = list(range(len(sets)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low[root(i)] = root(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [sets[i][0] for i in members if sets[i][0] is not None]
        out += [(sets[i][0], len(sets[i][1]), min(ids, default=None)) for i in members]
    return Counter(out)


def test_jaccard_join_on_awkward_rows(docs):
    got = Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect())
    assert got == components([(r[0], r[1]) for r in awkward_rows()], 4, 85)


def near_copies(seed):
    """Chains of edits around the threshold, with a passage that all share."""
    r = np.random.default_rng(seed)
    passage, rows = prose(99, 12), []
    for g in range(8):
        words = prose(1000 * seed + g, int(r.integers(20, 150))).split()
        for _ in range(25):
            for _ in range(int(r.integers(0, 3))):
                words[int(r.integers(len(words)))] = prose(int(r.integers(1 << 30)), 1)
            rows.append((len(rows), f"{passage} {' '.join(words)}"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_on_groups_of_near_copies(spark, seed):
    rows = near_copies(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(x) for x in jaccard.jaccard_components(d).collect()) == components(rows, 4, 85)
    kept = {x.doc_id for x in jaccard.keep_first(d, 5, 80).collect()}
    assert kept == {x[2] for x in components(rows, 5, 80)}


@pytest.mark.parametrize("limits", [(20_000, 2_000), (6, 3)])
def test_jaccard_links_are_all_there(spark, limits):
    """Every link between different sets with its overlap, also where lists and pivots are dealt out in parts."""
    rows = near_copies(3)
    d = spark.createDataFrame([*rows, (None, rows[0][1]), (500, None), (501, "")], "doc_id long, text string").repartition(3)
    join = jaccard.JaccardJoin(d, list_limit=limits[0], cell=limits[1])
    text = {x.node: dict(rows)[x.doc_id] for x in join.rows.where("doc_id < 500").collect()}
    got = {frozenset((text[x.a], text[x.b])): x.overlap for x in join.links(every=True).collect()}
    sets = {t: shingles(t, 4) for t in {t for _, t in rows}}
    both = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}
    assert got == {frozenset(k): n for k, n in both.items() if 100 * n >= 85 * (len(sets[k[0]]) + len(sets[k[1]]) - n)}
    found = jaccard.connected_components(join.links()).collect()
    assert len({x.node for x in found}) == len({t for k in got for t in k})


def test_jaccard_links_name_classes(docs):
    links, members = jaccard.jaccard_links(docs)
    class_of = {}
    for x in members.collect():
        class_of.setdefault(x.class_id, set()).add(x.n_shingles)
    assert all(len(n) == 1 for n in class_of.values()) and class_of[None] == {0}
    assert {x for r in links.collect() for x in (r.class_a, r.class_b)} <= class_of.keys()


def base_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_against_brute_force(spark):
    texts = [*(r[1] for r in awkward_rows()), "a b a b a b", "a b c d a b c", "x\ny\n\nx\n \nx", "# * | < >\n$%&", "a a a", "a a a a"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in decision_list.statistics(d).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_statistics(texts[r.doc_id]), r.doc_id


def test_rules_are_learned(spark):
    rows = [(i, prose(i, 60) + (" ### $$$ %%%" * 20 if i % 4 == 0 else "")) for i in range(300)]
    marks = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in decision_list.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), marks).collect()}
    assert all(got[i].kept == (i % 4 != 0 and not got[i].base_failed) for i in got)


def test_language_accuracy(spark):
    kinds = {"aa": "aeiou", "bb": "bcdfg", "cc": "lmnop"}
    rows = []
    for i in range(240):
        r, k = np.random.default_rng(i), list(kinds)[i % 3]
        rows.append((i, " ".join("".join(r.choice(list(kinds[k] + "st"), 5)) for _ in range(40)) + " 123", k))
    d = spark.createDataFrame([*rows, (1000, "123 !", "aa"), (1001, None, "bb")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_id(d).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _, _ in held) and sum(r.held_out for r in got.values()) >= len(held)
    assert sum(got[i].lang_pred == k for i, _, k in held) >= 0.97 * len(held)
    assert got[1000].lang_pred == got[1001].lang_pred == "und"


def test_parse_against_plain_longest_matches():
    """Phrases go on over the edges of blocks, also where no two parses meet within one."""
    samples = {"a": "the cat sat on the mat", "b": "der hund und die katze", "c": "ab" * 1500}
    m = langid.Model(samples)
    r = np.random.default_rng(4)
    long = " ".join(r.choice("the cat sat on mat hund und die katze der zzz".split(), 900))
    texts = ["the cat and the dog sat", "hund", "", "zzz", "The   CAT!", "x" * 3000 + " the cat", long, "ab" * 2600, "b" + "ab" * 1400]
    found, _ = m.parse(texts)
    for i, t in enumerate(texts):
        s = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in t.lower()))
        for k, train in enumerate(samples.values()):
            n = at = 0
            while at < len(s):
                end = at + 1
                while end <= len(s) and s[at:end] in train:
                    end += 1
                at = max(at + 1, end - 1)
                n += 1
            assert found[i][k] == n, (t[:20], k)


def test_any_number_of_languages_and_letters(spark):
    """Seventy languages, each with letters of its own, some beyond 16 bits."""
    alphabets = [[chr(x) for x in range(0x4E00 + 60 * k, 0x4E00 + 60 * k + 40)] for k in range(65)] + [[chr(x) for x in range(0x20000 + 60 * k, 0x20000 + 60 * k + 40)] for k in range(5)]
    r = np.random.default_rng(6)
    vocabulary = [["".join(r.choice(a, 4)) for _ in range(30)] for a in alphabets]
    rows = [(70 * j + k, " ".join(r.choice(v, 40)), f"l{k:02}") for j in range(4) for k, v in enumerate(vocabulary)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.language_id(d).collect()}
    taught = {k for i, _, k in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(taught) > 64 and all(got[i] == k for i, _, k in rows if k in taught)


def test_toxicity_finds_planted_words_on_held_out_texts(spark):
    rows = [(i, prose(i, 60) + (" Vilestuff" if i % 12 == 0 else " vilething and" if i % 12 == 4 else "")) for i in range(1200)]
    bad = {i for i in range(1200) if i % 4 == 0 and i % 12 in (0, 4)}
    marks = spark.createDataFrame([(i, 1, int(i in bad)) for i in range(1200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), marks).collect()}
    held = [i for i in got if got[i].held_out]
    assert held and all(got[i].predicted == (i in bad) for i in held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_quality_tells_junk_from_prose(spark):
    texts = []
    for i in range(600):
        sentences = [prose(10 * i + k, 12).capitalize() + "." for k in range(6)]
        texts.append(" ".join(sentences) if i % 5 else " ".join(sentences).upper().replace(" ", "!! ") if i % 2 else " ".join([prose(i, 1)] * 60))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality.classify(d).collect()}
    assert all(kept[i] for i in kept if i % 5) and sum(kept[i] for i in kept if i % 5 == 0) <= 6
    assert {r.doc_id for r in quality.keep_good(d).collect()} == {i for i in kept if kept[i]}


def test_label_model_finds_accuracies_and_correlations():
    from attesta.llm.weak import LabelModel, distinct_votes

    r = np.random.default_rng(0)
    y = r.random(20_000) < 0.3
    truth = [0.9, 0.8, 0.7, 0.85]
    v = np.stack([np.where(r.random(len(y)) < a, y, ~y) * 2 - 1 for a in truth], axis=1)
    v = np.concatenate([v, v[:, :1]], axis=1)  # a copy of the first voter
    p, n, index = distinct_votes(v)
    m = LabelModel(p, n, start=(p.sum(axis=1) > 0) * 0.8 + 0.1)
    assert np.abs(m.accuracies()[:4] - truth).max() < 0.06
    assert m.correlations[0, 4] > 0.5 and m.discount[0] < 0.7
    assert ((m.posterior(p)[index] > 0.5) == y).mean() > 0.88


def test_more_licences_by_hand(spark):
    texts = {
        1: "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n",
        2: "# SPDX-License-Identifier: GPL-2.0-or-later\nprint(1)",
        3: "This software is provided 'as-is', without any express or implied warranty.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n",
        4: " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n",
        5: "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        6: "The contents of this file are subject to nothing at all.",
    }
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "GPL-2.0-or-later", 3: "Zlib", 4: "LGPL-2.1-or-later", 5: "OFL-1.1", 6: ""}
    own = licences.scan(spark.createDataFrame([(1, "Do as you like.")], "doc_id long, text string"), sentences={"like": ["do as you like"]}, rules=[("Own", ["like"])])
    assert own.first().licences == "Own"


def test_shards_carry_size_and_checksum(docs):
    def plain(doc_id, text):
        data = (text or "").encode()
        return doc_id, len(data) + 8, zlib.crc32(data)

    got = Counter((r.doc_id, r.size, r.text_crc32) for r in sharding.shard_documents(docs).collect())
    assert got == Counter(plain(r[0], r[1]) for r in awkward_rows())


def test_scores_are_those_of_the_trained_models(spark):
    """What queries give for each row is what the model says of its whole text, one text at a time."""
    rows = [(i, (prose(i, 60) + (" Vilestuff" if i % 12 == 0 else "")) if i % 7 else prose(i, 40).upper().replace(" ", "!! ")) for i in range(300)] + [(300, None), (301, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 12 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, marks)
    known = {u: w for u, w in zip(model.units, model.weights)}
    for r in toxicity.toxicity(d, marks).collect():
        stems = Counter(s for t in set((rows[r.doc_id][1] or "").split()) for s in toxicity.stems_of(t))
        z = model.intercept + sum(known.get(u, 0.0) for u in toxicity.units_of(stems))
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9 and r.predicted == (r.score >= 0.7)
    good, _ = quality.train(d)
    for r in quality.classify(d).collect():
        at, values, _ = quality.Features()(rows[r.doc_id][1] or "")
        z = good.intercept + sum(good.weights[a] * v for a, v in zip(at, values))
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6 and r.kept == (r.score >= quality.THRESHOLD)


@pytest.mark.parametrize("name", ["keep_good", "exact", "jaccard", "copies"])
def test_keeping_rows_leaves_clashing_columns_alone(spark, docs, name):
    run = {"keep_good": quality.keep_good, "exact": exact_dedup.keep_first, "jaccard": jaccard.keep_first, "copies": mixing.take_copies}[name]
    odd = docs.select("*", docs.n_chars.alias("TEXT"), docs.n_chars.alias("Doc_Id"), docs.n_chars.alias("row"), docs.n_chars.alias("_1"), docs.n_chars.alias("__row"), docs.n_chars.alias("copies"))
    plain = sorted((tuple(r) for r in run(docs).collect()), key=repr)
    got = sorted((tuple(r) for r in run(odd).collect()), key=repr)
    assert run(odd).columns == odd.columns and [r[:5] for r in got] == plain and all(set(r[5:]) == {r[4]} for r in got)
    empty = spark.createDataFrame([], docs.schema)
    assert run(empty).count() == 0


def test_repeated_rows_are_taken_as_often_as_the_mix_says(spark):
    rows = [(i % 12, prose(i % 12, 20 + i % 12), "ab"[i % 2]) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.take_copies(d).count() == sum(r.copies for r in mixing.entropy_mix(d).collect())
