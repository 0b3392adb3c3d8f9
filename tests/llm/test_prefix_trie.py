"""The prefix trie against a dictionary of prefixes, over any number of shards."""

import hashlib
import random
import re
import zlib

import pytest

from mailscreen.llm.prefix_trie import TrieSettings, conversation_paths, prefix_trie, rebuilt_conversations

TURNS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def in_order(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    return {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt_by_hand(rows):
    own = in_order(rows)
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + turns[h:]
    return made


def by_hand(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def below(key):
        leaves, saved = 0 if key in children else 1, (len(members[key]) - 1) * (len(WORD.findall(key[-1][1])) if key else 0)
        for child in children.get(key, []):
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for key, convs_ in members.items():
        ends = sorted(c for c in convs_ if len(convs[c]) == len(key))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(convs_), len(key), min(members[key[:-1]]) if key else None, len(convs_), len(children.get(key, [])), *below(key), sha))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(5)
    made = []
    for c in range(-30, 260):
        opening = rng.choice([["hi there"], ["hi there", "how are you"], ["what  is this"], []])
        texts = opening + [rng.choice(["a b", "c", "", "hi there", "long one here"]) for _ in range(rng.randint(0, 3))]
        made += [(c, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(texts or ["alone"])]
    made += [(c, t, "user", "same") for c in range(1000, 1300) for t in range(3)]  # one very common conversation
    made += [(7, 0, "user", "again"), (7, 0, "user", "again"), (8, None, None, None), (9, None, "user", "first"), (None, 0, "user", "nobody")]
    made += [(2000, t, "user", f"turn {t % 7}") for t in range(400)] + [(2001, 0, "user", "word " * 30_000)]
    return made


def collected(trie):
    return sorted((tuple(r) for r in trie.collect()), key=repr)


@pytest.mark.parametrize("shards", [1, 2, 7, 60])
def test_nodes_do_not_depend_on_the_shards(spark, shards):
    given = spark.createDataFrame(rows(), TURNS)
    want = by_hand(in_order(rows()))
    assert collected(prefix_trie(conversation_paths(given), TrieSettings(shards=shards, chunk_ids=9))) == want


def test_rebuilt_conversations(spark):
    given = spark.createDataFrame([(*r, "x", 1) for r in rows()], TURNS + ", path string, depth int")
    assert collected(prefix_trie(rebuilt_conversations(given), TrieSettings(shards=11))) == by_hand(rebuilt_by_hand(rows()))


def test_small_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert collected(prefix_trie(rebuilt_conversations(empty))) == []
    one = spark.createDataFrame([(None, 1, "user", "a"), (21, None, None, None)], TURNS)
    assert collected(prefix_trie(conversation_paths(one))) == by_hand({21: [("", "")]})
    # h turns are taken from an absent conversation, so nothing is left but the root.
    turnless = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    alone = spark.createDataFrame([(turnless, 0, "user", "a")], TURNS)
    assert collected(prefix_trie(rebuilt_conversations(alone))) == by_hand({turnless: []})
