"""License scan: phrase places and template-markup matching on words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from gridspark.llm.common import map_texts

# Phrases that mark a license, as words, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notice templates.  [...] is optional wording, {n} stands for one to n replaceable words,
# all other words are mandatory and must match exactly.
TEMPLATES = {
    "mit": "released under the [terms of the] mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the {3} to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 [0] [the {1} you may not use this file except in compliance with the license]",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under [a] [the] [creative commons] cc by nc [4] [0] [license]",
    "gpl-3": "[this {4} is] licensed under the gnu general public license version 3 [or any later version]",
    "mpl-2": "subject to the terms of the mozilla public license v 2 [0]",
}

# Lower-cases A-Z and turns every byte that is no digit, letter or part of a wider character into a space.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def to_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def compile_template(markup: str) -> tuple[dict[int, list[tuple]], int, bytes]:
    """Token automaton of a template: moves by state, the accepting state, and a mandatory word as trigger.

    A move is (word or None, next state): None takes any word, and a move with word ``b""`` takes none.
    """
    moves: dict[int, list[tuple]] = {0: []}
    state, opened, required = 0, [], []

    def step(word) -> None:
        nonlocal state
        moves[state].append((word, state + 1))
        state += 1
        moves[state] = []

    for token in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", markup):
        if token == "[":
            opened.append(state)
        elif token == "]":
            moves[opened.pop()].append((b"", state))
        elif token[0] == "{":
            first = state
            for _ in range(int(token[1:-1])):
                step(None)
            for s in range(first + 1, state):
                moves[s].append((b"", state))
        else:
            if not opened:
                required.append(token.encode())
            step(token.encode())
    # The longest mandatory word is the rarest: the automaton runs only where it occurs.
    return moves, state, max(required, key=len)


def accepts(automaton, words: list[bytes], start: int) -> int:
    """End of the longest match that begins at ``start``, or -1."""
    moves, goal, _ = automaton

    def closure(states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for word, to in moves[todo.pop()]:
                if word == b"" and to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    states, at, best = closure({0}), start, -1
    while states:
        if goal in states:
            best = at
        if at >= len(words):
            break
        states = closure({to for s in states for word, to in moves[s] if word is None or word == words[at]})
        at += 1
    return best


def places(words: list[bytes], phrase: list[bytes], where: dict[bytes, list[int]]) -> list[int]:
    """Starts of ``phrase`` in ``words``, overlapping ones included; looked up from its rarest word here."""
    offset, key = min(enumerate(phrase), key=lambda x: len(where.get(x[1], ())))
    return [i - offset for i in where.get(key, ()) if i >= offset and words[i - offset:i - offset + len(phrase)] == phrase]


def scanner(phrases: dict[str, str], templates: dict[str, str]):
    """Function from texts to n_words, n_base, first_word, last_word, base_labels, labels, matches, score."""
    wanted = [(p.encode().split(), label) for p, label in phrases.items()]
    automata = [(label, compile_template(markup)) for label, markup in templates.items()]
    lengths = [sum(len(m) > 0 for m in a[0].values()) for _, a in automata]
    needed = {w for p, _ in wanted for w in p} | {a[2] for _, a in automata}
    # A phrase or template without any of these words cannot match; most texts have none.
    signs = [max(p, key=len) for p, _ in wanted if b"cc" not in p] + [a[2] for _, a in automata if b"cc" not in a[2]] + [b"cc"]

    def scan(texts):
        rows = []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass").translate(_WORD)
            words = raw.split()
            if not any(s in raw for s in signs):
                rows.append((len(words), 0, None, None, "", "", [], 0.0))
                continue
            where: dict[bytes, list[int]] = {}
            for i, w in enumerate(words):
                if w in needed:
                    where.setdefault(w, []).append(i)
            found = [(i, label) for p, label in wanted for i in places(words, p, where)]
            matches = []
            for (label, automaton), length in zip(automata, lengths, strict=True):
                for i in where.get(automaton[2], ()):
                    for start in range(max(0, i - length), i + 1):
                        if (end := accepts(automaton, words, start)) > i:
                            matches.append({"label": label, "start": start, "end": end})
                            break
            matches = [dict(t) for t in sorted({tuple(m.items()) for m in matches}, key=lambda t: [v for _, v in t[1:]])]
            base = sorted({label for _, label in found})
            labels = sorted({*base, *(m["label"] for m in matches)})
            starts = [i for i, _ in found]
            score = 1.0 if matches else 0.5 if found else 0.0
            rows.append((len(words), len(found), min(starts, default=None), max(starts, default=None),
                         ",".join(base), ",".join(labels), matches, score))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(8)]

    return scan


def scan_licenses(docs: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES,
                  templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``docs`` with word counts, phrase places, labels and template matches (label, start, end in words).

    ``score`` is 1 where a whole template is accepted, 0.5 where only a phrase occurs, else 0.  Null and empty
    texts have 0 words and no labels; places are null without any.  All rows and other columns are kept; columns
    with the added names are replaced.  One pass, no shuffle.
    """
    added = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"),
             ("base_labels", "string"), ("labels", "string"),
             ("matches", "array<struct<label:string,start:bigint,end:bigint>>"), ("score", "double")]
    return map_texts(docs, text, added, lambda: scanner(phrases, templates))
