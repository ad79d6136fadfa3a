"""Chat windows and token files: exact round trips."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import chat_format, queries, token_files
from riskspark.session import work_path

from .helpers import odd_texts, sentence

FOLDER = "/root/testdata/sf0.001"
PIECES = ["<", "|", "\\", "<|im_end|>", "<|im_start|>", "assistant", "\n", "ok", "é", " ", "im_end|>"]


def odd_turns():
    rng = random.Random(5)
    rows = []
    for conv in range(40):
        n = rng.choice([1, 2, 3, 9, 30])
        for turn in range(n):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "assistant", None, "a\nb\\n<|im_end|>"])
            text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(12))) if conv % 3 else sentence(conv * 50 + turn, rng.choice([3, 60, 700]))
            rows.append((conv, turn, role, rng.choice([text, text, text, None, ""])))
    rows += [(77, None, "user", "null turn"), (77, 0, "assistant", "x"), (77, 0, "assistant", "x"), (None, 0, "assistant", "no id"), (None, None, None, None)]
    # ids beyond 2**53 beside a missing one
    rows += [((1 << 60) + 1, 0, "user", "first"), ((1 << 60) + 3, 0, "assistant", "second"), ((1 << 53) + 1, 1, "user", "third")]
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)]
    return rows


def plain_digests(rows):
    conversations = defaultdict(list)
    low = lambda x: (x is not None, x)  # noqa: E731  NULL first
    for conv, turn, role, text in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[2] or "", r[3] or "")):
        conversations[conv].append((role or "", text or ""))
    out = {}
    for conv, turns in conversations.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        turned = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(turned.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(10)))
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert chat_format.unescape_role(chat_format.escape_role(text)) == text
        assert "<|" not in chat_format.escape(text) and "\n" not in chat_format.escape_role(text)


@pytest.mark.parametrize(("budget", "history", "history_tokens"), [(512, 2, 128), (20, 3, 12), (1, 0, 0)])
def test_read_back_equals_the_turns(spark, budget, history, history_tokens):
    rows = odd_turns()
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, window string")
    made = chat_format.windows(frame, budget, history, history_tokens).cache()
    for w in made.collect():
        assert w.n_tokens <= budget or w.n_turns - w.n_repeated == 1
        assert w.n_repeated <= history + 1 and len(chat_format.parse(w.text)) == w.n_turns
        if w.window and chat_format.parse(w.text)[0][0] == "system":
            assert w.n_repeated >= 1
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(made).collect()}
    assert out == plain_digests(rows)
    assert chat_format.read_back(chat_format.windows(frame.limit(0))).count() == 0


def test_query_adds_the_tricky_conversation(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)]
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op6_chat_format(spark, FOLDER).collect()}
    assert out == plain_digests(rows)


# --- token files -------------------------------------------------------------------------


def test_counts_equal_the_encoding(spark):
    tokens = token_files.encoding()
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected = {r.doc_id: len(tokens.encode_ordinary(r.text or "")) for r in rows}
    assert {r.doc_id: r.n_tokens for r in queries.op7_token_counts(spark, FOLDER).collect()} == expected


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_stitching_over_block_borders(spark, block):
    texts = [(0, i, t if len(t or "") < 5000 else t[:5000]) for i, (_, t) in enumerate(odd_texts())]
    frame = spark.createDataFrame([*texts, (1, 0, None), (1, 1, "<|endoftext|>")], "part long, row long, text string").coalesce(1)
    path = work_path(spark, "test-tokens")
    token_files.write_flat(frame, path, ["part"], ["row"])
    tokens = token_files.encoding()
    out = {(r.part, r.number): (r.n_tokens, r.closed) for r in token_files.scan(spark, path, ["part"], block=block).collect()}
    expected = {(p, r): (len(tokens.encode_ordinary(t or "")), True) for p, r, t in [*texts, (1, 0, None), (1, 1, "<|endoftext|>")]}
    assert out == expected


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_scan_of_random_identifiers(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    folder = tmp_path / "flat" / "part=3"
    folder.mkdir(parents=True)
    expected = {}
    for name in ("part-a", "part-b"):
        ids = rng.integers(0, 3, 60)
        (folder / name).write_bytes(ids.astype(">u2").tobytes())
        run = 0
        for i in ids:
            if i == 2:
                expected[len(expected)] = (run, True)
                run = 0
            else:
                run += 1
        if run:
            expected[len(expected)] = (run, False)
    (folder / "part-c").write_bytes(b"")
    out = token_files.scan(spark, str(tmp_path / "flat"), ["part"], separator=2, block=block)
    assert {r.number: (r.n_tokens, r.closed) for r in out.collect()} == expected


def test_a_broken_file_fails(spark, tmp_path):
    (tmp_path / "part=1").mkdir()
    (tmp_path / "part=1" / "part-a").write_bytes(b"abc")
    with pytest.raises(Exception, match="multiple"):
        token_files.scan(spark, str(tmp_path), ["part"]).select(F.sum("n_tokens")).collect()
