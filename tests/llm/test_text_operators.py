import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridgeline.llm import decontaminate, licenses, packing, quotes, sharding, tokenize, toxicity, wordpiece

from .conftest import ODD


def test_packing_is_whole_and_tight(spark, docs):
    words = ["alpha", "Beta,", "gamma!", "Straße", "x1", "naïve.", "don't", "<|endoftext|>", "漢字"]
    texts = [(100 + i, " ".join(words[(i * j) % 9] for j in range(1, 40 * i % 3000 + 2))) for i in range(60)]
    rows = packing.pack(docs(*texts, *ODD)).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc_id, text in texts[:20]:
        ids = encode.encode(text, add_special_tokens=False).ids + [0]
        mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc_id)
        want = [(k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], dtype="<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert mine == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in rows) // 2048) + 2
    assert sum(r["doc_id"] == 4 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert packing.pack(docs((1, "a")).limit(0)).count() == 0


def test_cached_ids_equal_the_tokenizer():
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(3)
    parts = ["a", "b", "Z", "H", "T", "İ", "ß", "É", "é", "ñ", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "'s", "'", "!", "&&", "<|", "|>", "endoftext"]
    parts += ["<|endoftext|>", "<|ENDOFTEXT|>", "\u0301", "\u0331", "1", "²", "漢", "\U0001f600", "ſ", "\u212a", "Σ", "ς", "µ", "ª", "_", '"', "(", "word", "ÿ", "÷", "\0"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(5000)]
    for own in (tokenize.WordEncoder(), tokenize.WordEncoder(cache_entries=300, cache_bytes=10_000)):  # the second forgets often
        got = [ids for i in range(0, len(texts), 250) for ids in own.encode([t.encode() for t in texts[i : i + 250]])]
        assert got == [tokenize.packed(whole.encode(t, add_special_tokens=False).ids) for t in texts]


def test_plan_uses_every_piece_once():
    counts = {2048: 3, 1500: 7, 1100: 5, 900: 11, 700: 2, 600: 40, 33: 200, 1: 500}
    runs, sequences = packing.plan(counts)
    assert {k: sum(b - a + 1 for n, a, b, *_ in runs if n == k) for k in counts} == counts
    total = sum(k * n for k, n in counts.items())
    assert sequences <= -(-total // 2048) + 4



def test_counts_equal_greedy_matching_of_the_registered_vocabulary(spark):
    """Every word of the documents against the plain longest match, the vocabulary as a set of byte strings."""
    known = set(wordpiece.vocabulary("byte_bpe_50k.json"))
    most = max(map(len, known))

    def greedy(word):
        rest, n = b" " + word.encode(), 0
        while rest:
            rest, n = next(rest[k:] for k in range(min(most, len(rest)), 0, -1) if rest[:k] in known), n + 1
        return n

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: wordpiece.WORD.findall(r["text"] or "") for r in source.collect()}
    pieces = {w: greedy(w) for words in texts.values() for w in words}
    got = {r["doc_id"]: r for r in wordpiece.count_tokens(source).collect()}
    assert set(got) == set(texts) and len(pieces) > 1000
    for i, words in texts.items():
        assert (got[i]["n_words"], got[i]["n_pieces"], got[i]["longest"]) == (len(words), sum(pieces[w] for w in words), max((pieces[w] for w in words), default=0))


def test_words_beyond_a_vocabulary_and_beyond_the_cache():
    pieces = wordpiece.Counter(wordpiece.Automaton([b" ", b" a", b"a", b"ab"]))
    assert [pieces[w] for w in ("a", "aab", "q", "aq")] == [1, 2, 1, 1]
    assert pieces["a" * 10_000] == 10_000 and set(pieces) == {"a", "aab", "q", "aq"}


def test_word_pieces(spark, docs):
    counter = wordpiece.Automaton([b"a", b"ab", b"abc", b"bcd", b"b", b"c", b"d", b"cdx"])
    entries = {b"a", b"ab", b"abc", b"bcd", b"b", b"c", b"d", b"cdx"}

    def greedy(w):
        n = 0
        while w:
            k = next((k for k in range(len(w), 0, -1) if w[:k] in entries), 0)
            if not k:
                return -1
            w, n = w[k:], n + 1
        return n

    import itertools

    for n in range(1, 7):
        for w in itertools.product(b"abcdx", repeat=n):
            assert counter.count(bytes(w)) == greedy(bytes(w))
    rows = {r["doc_id"]: r for r in wordpiece.count_tokens(docs(*ODD)).collect()}
    assert (rows[1]["n_words"], rows[2]["n_pieces"]) == (0, 0) and rows[6]["n_words"] == 20_000
    assert wordpiece.count_tokens(docs(*ODD)).count() == len(ODD)


def test_shards_fit(spark, docs):
    many = [(i, "t" * (i % 90)) for i in range(400)] + [(7, "y" * 100)] * 300
    rows = sharding.assign(docs(*many, *ODD), limit=2_000).collect()
    assert len(rows) == len(many) + len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["bytes"])
        assert r["bytes"] <= r["shard_bytes"]
    assert all(sum(b) <= 2_000 or len([x for x in b if x]) == 1 for b in by.values())
    assert all(sum(by[r["shard"]]) == r["shard_bytes"] for r in rows)
    plain = [b for b in by if "." not in b]
    assert not any(a != b and b.startswith(a) for a in plain for b in plain)  # prefixes: no shard inside another
    assert sharding.assign(docs((1, "a")).limit(0)).count() == 0


def test_licenses(spark, docs):
    text = "Apache License, Version 2.0. See the MIT license; CC-BY 4.0! GNU General Public License\nmit license"
    rows = {r["doc_id"]: r for r in licenses.scan(docs((9, text), (10, "all fine"), *ODD)).collect()}
    r = rows[9]
    words = licenses.words_of(text)
    places = sorted(i for p, _ in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), places[0], places[-1])
    assert r["base_labels"] == "apache,cc-by,gpl,mit" and "apache-2.0" in r["labels"].split(",") and 0 < r["score"] <= 1
    assert rows[10]["first_word"] is None and rows[10]["labels"] == "" and rows[10]["score"] == 0 and rows[1]["n_words"] == 0
    assert len(licenses.FAMILIES) + len(licenses.SIGNATURES) > 200


def test_contained_detections_are_suppressed(spark, docs):
    r = licenses.scan(docs((1, "Licensed under CC BY-NC 4.0."))).first()
    assert r["labels"] == "cc-by,cc-by-nc-4.0" and r["base_labels"] == "cc-by"


def samples(regex):
    """Texts that a regex over words matches: every alternative, optional parts left out and put in."""

    def walk(parsed):
        out = [""]
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "NOT_LITERAL":
                more = ["x"]
            elif name == "IN":
                more = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
            elif name == "SUBPATTERN":
                more = walk(arg[3])
            elif name == "BRANCH":
                more = [x for branch in arg[1] for x in walk(branch)]
            elif name == "MAX_REPEAT":
                more = [x * n for n in sorted({arg[0], max(arg[0], 1)}) for x in walk(arg[2])]
            else:
                assert name in ("ASSERT", "ASSERT_NOT"), name
                more = [""]
            out = list(dict.fromkeys(a + b for a in out for b in more))
        return out

    return walk(re._parser.parse(regex))


def test_every_license_rule_fires_on_its_own_match(spark, docs):
    of = [(rule, text) for rule in licenses.rules() for text in samples(rule[1])]
    assert all(re.fullmatch(rule[1].removeprefix("(?<= )").removesuffix("(?= )"), text) and f" {rule[0]} " in f" {text} " for rule, text in of)
    got = {r["doc_id"]: r for r in licenses.scan(docs(*((i, text) for i, (_, text) in enumerate(of)))).collect()}
    assert [text for i, (rule, text) in enumerate(of) if not got[i]["labels"] or got[i]["score"] < rule[4]] == []


def test_license_names_without_license_words(spark, docs):
    want = {
        "MPL 2.0": "mpl-2.0", "https://mozilla.org/MPL/2.0/": "mpl-2.0", "WTFPL": "wtfpl", "released under the BSD 3-Clause": "bsd-3-clause", "FreeBSD": "bsd-2-clause",
        "simplified BSD": "bsd-2-clause", "CreativeML OpenRAIL-M": "openrail", "with Reserved\nFont Name": "ofl", "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa-4.0",
        "Creative Commons Attribution NonCommercial NoDerivs License": "cc-by-nc-nd", "Licence Ouverte 2.0": "etalab-2.0", "You may not use this file except in compliance with the License.": "apache-2.0",
        "success of an account by others": "",
    }
    rows = licenses.scan(docs(*enumerate(want))).collect()
    assert {list(want)[r["doc_id"]]: r["labels"] for r in rows} == want


def plain_license_scan(text, table):
    """(labels, score) by every rule at every place, and every detection held against every other."""
    words = licenses.words_of(text)
    norm, found = f" {' '.join(words)} ", set()
    for _, regex, label, priority, weight in table:
        found |= {(*m.span(), label, priority, weight) for m in re.finditer(regex, norm)}
    inside = lambda d, e: e[3] >= d[3] and e[0] <= d[0] and e[1] >= d[1] and (e[1] - e[0] > d[1] - d[0] or e[3] > d[3])
    stays = [d for d in found if not any(inside(d, e) for e in found)]
    base = [label for phrase, label in licenses.BASE if f" {phrase} " in norm]
    return ",".join(sorted({*base, *(d[2] for d in stays)})), max([0.0, *(d[4] for d in stays), *([licenses.KINDS["base"][1]] if base else [])])


def test_license_scan_equals_all_rules_and_pairs(spark, docs):
    table, r = licenses.rules(), random.Random(12)
    matches = [x for rule in r.sample(table, 200) for x in samples(rule[1])[:3]]
    texts = [" ".join(r.choice(matches) if r.random() < 0.6 else r.choice(["the", "license", "version 2", "under", "gnu", "by"]) for _ in range(r.randint(1, 12))) for _ in range(250)]
    texts += ["the mit license and " * 700, "gpl " * 900 + "gnu general public license version 3 " * 300]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs(*enumerate(texts))).collect()}
    want = [plain_license_scan(t, table) if len(t) < 10_000 else None for t in texts]
    assert [(t, got[i], w) for i, (t, w) in enumerate(zip(texts, want)) if w and got[i] != w] == []
    assert got[250] == ("mit", 0.7) and got[251] == ("gpl,gpl-3", 0.85)


def test_license_scan_is_linear_in_matches(spark, docs):
    began = time.time()
    row = licenses.scan(docs((1, "the mit license and " * 100_000))).first()
    assert (row["n_base"], row["labels"]) == (100_000, "mit") and time.time() - began < 60


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "too short to count"), (None, ITEM), (3, None)], "item_id long, text string")
    changed = ITEM.replace("eight ", "acht ").replace("sixteen", "sechzehn")
    noise = " ".join(f"w{i}" for i in range(57))
    rows = [(20, ITEM.upper()), (21, f"{noise} {ITEM} {noise}"), (22, f"{noise} {changed} {noise}"), (23, noise), (24, "one two three"), (25, f"{noise[:100]} {' '.join(ITEM.split()[:15])} {noise}")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs(*rows, *ODD), bench).collect()}
    assert got == {(20, 1), (21, 1), (22, 1), (25, 1)}
    kept = decontaminate.clean(docs(*rows, *ODD), bench)
    assert kept.columns[:3] == ["doc_id", "text", "lang"] and kept.count() == 2 + len(ODD)
    assert decontaminate.overlaps(docs(*rows), bench.limit(0)).count() == 0
    few = decontaminate.overlaps(docs(*rows), bench, broadcast_seeds=0)  # the path without broadcasts
    assert {(r["doc_id"], r["item_id"]) for r in few.collect()} == got


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow do I pack bins?"),
        (1, 1, "a", "Use best fit.\nIt is simple."),
        (1, 2, "u", "On Monday, Ann wrote:\n> Hello there.\n> How do I pack bins?\nI have the same question"),
        (1, 3, "a", "> On Monday, Ann wrote:\n> > Hello there.\n> I have the same  question!\nSee above"),
        (1, 4, "u", "> It is simple.\nNot for me"),
        (1, 5, "u", "> nothing known\nok"),
        (2, 0, "u", None),
        (2, 1, "a", ""),
        (None, 1, "u", "x"),
        (3, 4, "u", "gap"),
        (3, 9, "u", "> gap\nyes"),
        (3, 9, "u", "> gap\nyes"),
        (4, 0, "u", "Thanks."),
        (4, 1, "a", "You are welcome"),
        (4, 2, "u", "Thanks."),
        (4, 5000, "a", "> thanks\nfine"),
        (4, 9000, "a", "> THANKS!\n\n>>> print(1)\n1"),
        (5, 0, "u", ">>> print(1)\n1"),
        (5, 1, "u", "On the board I wrote:\nbuy milk"),
        (5, 2, "u", "On Monday, Bob wrote:\n> lost words\n>> more\nwhat?"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(df).collect()}
    assert [got[1, t]["parent_turn"] for t in range(6)] == [None, 0, 0, 2, 1, 4]
    assert [got[1, t]["depth"] for t in range(6)] == [0, 1, 1, 2, 2, 3]
    assert got[1, 2]["text"] == "I have the same question" and got[1, 3]["n_quoted"] == 3
    assert not got[1, 5]["linked"] and got[3, 9]["linked"] and got[2, 0]["text"] is None and got[None, 1]["root_turn"] is None
    assert got[1, 5]["text"] == "> nothing known\nok" and got[1, 5]["n_quoted"] == 0
    assert got[4, 5000]["parent_turn"] == got[4, 9000]["parent_turn"] == 2 and got[4, 9000]["text"] == ">>> print(1)\n1"  # the latest that said it
    assert got[5, 0]["text"] == rows[-3][3] and got[5, 1]["text"] == rows[-2][3]
    assert got[5, 2]["text"] == "what?" and got[5, 2]["n_quoted"] == 2 and not got[5, 2]["linked"]
    assert quotes.link(df.withColumns({"hash": F.lit(1), "level": F.lit(2), "key": F.lit("x"), "at": F.lit(0)})).count() == len(rows)
    assert quotes.link(df).count() == len(rows) and quotes.link(df.limit(0)).count() == 0

    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    columns = quotes.link(df).columns
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({quotes.oracle()}) t").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in quotes.link(df).collect())


def test_toxicity_on_held_out_rows(spark, docs):
    import random

    r = random.Random(3)
    vocabulary = ["".join(r.choice("aeinrstlod") for _ in range(r.randint(3, 8))) for _ in range(400)]
    rows, marks = [], []
    for i in range(900):
        words = [r.choice(vocabulary) for _ in range(60)]
        toxic = int(r.random() < 0.2)
        for _ in range(3 * toxic):
            words[r.randrange(60)] = r.choice(["idiot", "scum", "zorbling", "zorbed"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, toxic))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs(*rows, (5000, None), (5001, "")), labels).collect()
    truth = {i: t for i, _, t in marks}
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) / len(held) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got) and len(got) == 902
    plain = toxicity.classify(docs((1, "you worthless idiot"), (2, "a fine day")), labels.limit(0)).collect()
    assert {x["doc_id"]: x["predicted"] for x in plain} == {1: 1, 2: 0}


def test_label_model_recovers_planted_voters():
    """No label is given: accuracies, the prior and a copied voter are found from the votes alone."""
    rng = np.random.default_rng(4)
    truth = rng.random(6000) < 0.3
    accuracies = [0.9, 0.85, 0.8, 0.75, 0.7, 0.65]
    votes = []
    for accuracy in accuracies:
        right = rng.random(6000) < accuracy
        votes.append(np.where(rng.random(6000) < 0.8, np.where(right == truth, 1, -1), 0))
    copied = np.where(rng.random(6000) < 0.95, votes[-1], 0)
    posterior, found = toxicity.label_model(np.array([*votes, copied], dtype=float).T)
    assert np.abs(found["accuracy"][:6] - accuracies).max() < 0.06 and abs(found["prior"] - 0.3) < 0.06
    assert found["correlation"][5, 6] > 0.5 and found["weight"][6] < 0.75 and found["weight"][:4].min() > 0.9
    assert ((posterior > 0.5) == truth).mean() > max(((np.array(v) > 0) == truth).mean() for v in votes)


def test_toxicity_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)] + [(None, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    rows = [(i, "you stupid idiot zorb" if i % 2 else "a calm and fine day") for i in range(40)]
    got = toxicity.classify(docs(*rows, *rows[:5], *ODD), labels).collect()
    assert len(got) == 45 + len(ODD) and all(0 <= r["score"] <= 1 for r in got) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert len({(r["doc_id"], r["score"]) for r in got if r["doc_id"] in range(8, 40)}) == 32
    assert toxicity.classify(docs((1, "a")).limit(0), labels).count() == 0


def test_xxhash_seed_is_that_of_the_contract(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b", 42)
    assert re.fullmatch("[01]+", decontaminate.MASKS[0])


def test_decontamination_meets_substituted_passages(spark, docs):
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (11, 12, 13, 15)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    want, rows, of = {}, [], {}

    def add(n, changed, at):
        said = [f"new{k}" if k in changed else w for k, w in enumerate(items[n])]
        of[len(rows)] = (n, len(changed))
        rows.append((len(rows), " ".join([f"a{k}" for k in range(20 + at)] + said + [f"z{k}" for k in range(20)])))

    for at in range(4):
        for n in (11, 12, 13):
            add(n, (), at)
        for count in (2, 3):
            for changed in itertools.combinations(range(15), count):
                add(15, changed, at)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs(*rows), bench).collect()}
    assert all(of[i][0] == n for i, n in found)
    for key in of.values():
        want[key] = want.get(key, 0) + 1
    recall = {key: sum(of[i] == key for i, _ in found) / all_of for key, all_of in want.items()}
    assert recall[11, 0] == recall[12, 0] == recall[13, 0] == 1
    assert recall[15, 2] >= 0.99 and recall[15, 3] >= 0.87


def test_decontamination_meets_short_items_whole(spark, docs):
    bench = spark.createDataFrame([(1, "Four words, no more"), (2, "one two three four five six seven eight nine ten"), (3, "!"), (4, "lone")], "item_id long, text string")
    rows = [(30, "four words no more"), (31, "a b four WORDS: no more c"), (32, "four words no"), (33, "x one two three four five six seven eight nine ten"), (34, "one two three four five six seven eight nine x ten"), (35, "lone"), (36, "alone")]
    for many in (1_000_000, 0):
        got = sorted((r["doc_id"], r["item_id"], r["n_hits"], r["best"]) for r in decontaminate.overlaps(docs(*rows), bench, broadcast_seeds=many).collect())
        assert got == [(30, 1, 1, 4), (31, 1, 1, 4), (33, 2, 1, 10), (35, 4, 1, 1)]
