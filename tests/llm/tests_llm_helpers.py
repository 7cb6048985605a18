"""Brute-force versions shared by the tests of the corpus operators."""

import random
import re
from collections import defaultdict

import pytest


def brute_lines(rows):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 5 or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.fixture(scope="session")
def words():
    """Invented words; a fixed seed."""
    source = random.Random(5)
    return ["".join(source.choice("abcdefghij") for _ in range(source.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that operators have to survive."""
    return [None, "", " ", "\n", "a", "  two  spaces ", "tab\tand\nline\r\n", "Äpfel ÄPFEL äpfel", "▁ marked ▁▁ text", "日本語 のテキスト", "x" * 5000, "word " * 3000, " odd　spaces here", "<|endoftext|> and </s>", "🙂 emoji 👩‍👩‍👧"]
