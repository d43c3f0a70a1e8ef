"""What workers remember: pieces met again outlast those met once, and other operators' memories are freed."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

from changefeed.llm import bpe, tokens
from changefeed.llm.common import Memory, Recent, worker_cache


def test_pieces_met_again_are_kept_and_results_do_not_depend_on_it():
    rnd, memory, learned = random.Random(2), Memory(), 0
    for turn in range(60):
        met = {f"often {i}" for i in range(20)} | {f"once {turn} {i}" for i in range(rnd.randrange(30))}
        new = memory.room_for(met, 150)
        assert new == met - memory.keys()
        learned += sum(x.startswith("often") for x in new)
        memory.update((x, x.upper()) for x in new)
        assert all(memory[x] == x.upper() for x in met) and len(memory) <= 150
    assert learned == 20
    big = {str(i) for i in range(400)}
    assert memory.room_for(big, 150) == big  # one round may be larger than the memory


def test_a_worker_holds_one_operators_memory():
    worker_cache("a")["x"] = [1]
    worker_cache("b")["y"] = 2
    assert worker_cache("b") == {"y": 2} and worker_cache("a") == {}


def test_looking_up_a_piece_learns_it_and_pieces_met_again_outlast_others():
    learned: list[str] = []
    memory = Recent(lambda x: learned.append(x) or x.upper().encode(), 100)
    for turn in range(200):
        for x in (*(f"often {i}" for i in range(20)), *(f"once {turn} {i}" for i in range(7))):
            assert memory[x] == x.upper().encode()
            assert len(memory) + len(memory.past) <= 100
    assert sum(x.startswith("often") for x in learned) == 20
    assert memory.get_or("other", str.encode) == b"other" == memory["other"] and memory.knows("other")


def test_texts_in_other_scripts_do_not_fill_the_memory_beyond_its_bound(monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(tokens, "MEMORY", 60)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        held = f.read()
    encoder, plain, rnd = tokens.Encoder(held), Tokenizer.from_str(held), random.Random(4)
    for _ in range(40):
        texts = [" ".join("".join(rnd.choices("abcé,7ж字", k=rnd.randint(1, 6))) for _ in range(15)) + end for end in ("", "\n", "<|endoftext|>x")]
        want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(texts)] == want
        assert len(encoder.pieces) + len(encoder.pieces.past) <= 60


def test_decoding_takes_rows_of_the_vocabulary_and_remembers_nothing():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.Codec(bpe.read_ranks(path), public_tokenizers.PATTERN, characters=40)
    texts = ["", "one two", " \n\n", "é字ж <|endoftext|>", "", "one two three " * 30, ""]
    ids = list(codec.encode(texts))
    codec.con.close()
    held = len(codec.pieces)
    assert list(codec.decode(ids)) == [t.encode() for t in texts] and list(codec.decode([])) == []
    assert held == len(codec.pieces) and not any(isinstance(x, dict) and x is not codec.pieces for x in vars(codec).values())


def test_a_round_of_texts_makes_a_string_of_each_different_piece_only(monkeypatch):  # noqa: ANN001
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read())
    plain = ["the cat, the dog\nand the cat", "", "été à la mer. 漢字 もの the", "x", "it's 12.5 (now) 😀", "a\nb\nc the", "É. ñ, a., b., .c, 1. ,, the, (the. \xad, ª. x²."]
    odd = ["two  spaces", " first", "last ", "end\n", "a\0b c", "tab\tthe", "\n\n", "no\xa0break", "a <|endoftext|> b <|endoftext|>", "\0", " "]
    looked_up: list[str] = []
    real = type(encoder.pieces)

    class Spied(real):
        def __getitem__(self, x: str) -> bytes:
            looked_up.append(x)
            return super().__getitem__(x)

    encoder.pieces = Spied(encoder._learn, 1000)
    library = encoder.tokenizer
    for texts in (plain, odd, plain + odd, odd[:1] + plain[:1], [""], [], odd[-2:]):
        assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    looked_up.clear()
    monkeypatch.setattr(tokens, "cut", None)  # cuts a text into Python strings
    ids = encoder.encode(["the cat and the dog and the end"] * 500)
    assert len(ids) == 500 and len(looked_up) < 10
    assert ids[499].tolist() == library.encode("the cat and the dog and the end", add_special_tokens=False).ids
