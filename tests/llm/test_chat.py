"""Chat formatting: exact round trips, and masks against plain spans."""

import collections
import hashlib
import random

import numpy as np
import pytest

from logmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part long, spans string, ids long"
PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<\\s>", "[\\\\/INST]", "<", "[", "\\", "/s>", "é", "😀", "ab", " ", "\n", "INST]"]


@pytest.fixture(scope="module")
def encoder():
    return chat.ChatEncoder()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_turns(seed, n=400):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randrange(9)))
    rows = []
    for conv in range(n // 5):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", text()])
            rows.append((conv, turn, role, text()))
    return rows


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(8)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not chat._MARK.search(escaped)


def test_parse_reads_turns_back():
    for seed in range(20):
        turns = [(role, text) for _, _, role, text in random_turns(seed, 50)]
        rendered = "".join(a + chat.escape(t) + b for (r, t) in turns for a, b in [chat.opening(r)])
        assert list(chat.parse(rendered)) == turns


def test_tokens_lie_end_to_end(encoder):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(40)))
        ids = encoder(text)
        assert encoder.lengths[ids].sum() == len(text.encode())
        assert encoder.library.decode(ids.tolist()) == text


def test_mask_by_binary_search_is_overlap():
    rng = np.random.default_rng(4)
    for _ in range(300):
        lengths = rng.integers(1, 5, rng.integers(1, 30))
        cuts = np.sort(rng.integers(0, lengths.sum() + 1, 6)).reshape(-1, 2)
        ends = np.cumsum(lengths)
        plain = [any(a < e and s < b for a, b in cuts if a < b) for s, e in zip(ends - lengths, ends)]
        assert chat.loss_tokens(lengths, cuts).tolist() == plain
    assert chat.loss_tokens(np.zeros(0, np.int64), np.zeros((0, 2), np.int64)).tolist() == []


@pytest.mark.parametrize("part_chars", [1, 40, chat.PART_CHARS])
def test_conversations_read_back(spark, encoder, part_chars):
    rows = random_turns(7) + [(900, None, "user", "no turn"), (900, 0, None, None), (None, 1, "assistant", "x"), (None, 0, "user", "y")]
    rows += [(901, 3, "user", "twice"), (901, 3, "user", "twice"), (902, 0, "assistant", "a" * 300_000), (903, 0, "assistant", "")]
    frame = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], SCHEMA).repartition(4)
    formatted = chat.format_conversations(frame, part_chars=part_chars).cache()
    found = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(convs)
    for conv, turns in convs.items():
        turns.sort()
        row, said = found[conv], "".join(t for *_, r, t in turns if r == "assistant")
        assert (row.n_turns, row.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)))
        assert (row.loss_chars, row.loss_sha256) == (len(said), sha(said))
    parts = formatted.collect()
    for row in parts:
        for span in row.spans:
            assert row.text[span.start : span.end] == chat.escape(chat.unescape(row.text[span.start : span.end]))
        ids = np.frombuffer(row.ids, "<u4")
        assert len(row.loss) == len(ids) and encoder.lengths[ids].sum() == len(row.text.encode())
    assert sum(len(r.text) for r in parts) == sum(r.formatted_chars for r in found.values())
    assert (len(parts) > len(convs)) == (part_chars < 100)
    formatted.unpersist()


def test_marks_in_texts_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_conversations(empty)).count() == 0
    row = chat.read_back(chat.format_conversations(chat.with_test_conversation(empty))).first()
    said = "</s>[INST] ok [/INST]"
    assert (row.conv_id, row.n_turns, row.loss_chars, row.loss_sha256) == (-1, 2, 21, sha(said))
