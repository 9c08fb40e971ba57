"""Language-model scoring by a weighted backoff automaton.

Smoothed n-grams of the training texts are the automaton: a state for each n-gram that may be a context, an
arc from a context h over a word w for each n-gram hw that training holds, and from each state a failure
arc to the state of its longest proper suffix. A text is read once from left to right: the state is carried
along, failure arcs are taken until one for the word leaves the state, and the log-probabilities of all
arcs taken are added up.

The probability of a word w after a context h with the counts c is (c(hw) + mu * p(w|h')) / (c(h) + mu),
h' being h without its first word; p(w) = (c(w) + 1) / (N + V + 1). So an arc of hw weighs that, the failure
arc of h weighs mu / (c(h) + mu), and the probabilities after each h sum to 1.

The automaton of a corpus has about as many arcs as the corpus has words, so it lies over the cluster: the
counts of all n-grams are added up by the exchange, and each block of texts gets the part that its texts
can reach (all n-grams in them; no other arc can be taken), builds states and arcs from it and walks them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from .common import fold_of, mix, word_hashes
from .exchange import count_keys, distinct_keys, for_each_block, make_blocks

END, BEGIN = np.uint64(xxhash.xxh64_intdigest(b"\n end")), np.uint64(xxhash.xxh64_intdigest(b"\n begin"))


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A begin, the words and an end of each text, one text after another, and where each begins (and the last ends)."""
    words, at = word_hashes(texts)
    starts = at + 2 * np.arange(len(texts) + 1)
    tokens = np.empty(int(starts[-1]), dtype=np.uint64)
    inner = np.ones(len(tokens), dtype=bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    tokens[starts[:-1]], tokens[starts[1:] - 1], tokens[inner] = BEGIN, END, words
    return tokens, starts


def longer(context: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """The keys of n-grams from those of their contexts (n - 1 tokens; any for n = 1) and their last words."""
    with np.errstate(over="ignore"):
        return mix((mix(word + np.uint64(n)) if n == 1 else context * np.uint64(0x9E3779B97F4A7C15) + word) ^ np.uint64(n))


def ngram_keys(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order the places at which n-grams end, which lie in one text each, and their keys."""
    place = np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))
    whole, out = tokens, []
    for n in range(1, order + 1):
        at = np.flatnonzero(place >= n - 1)
        keys = longer(whole[at - 1] if n > 1 else tokens, tokens[at], n)
        whole = np.zeros(len(tokens), dtype=np.uint64)
        whole[at] = keys
        out.append((at, keys))
    return out


@dataclass
class Automaton:
    """Index n of each list is of the n-grams that training holds, in the order of their keys (index 0 is not used):
    the weight of the arc to each, the state that it leads to (of `length` tokens) or, as a state, its failure arc's weight
    and target among the (n - 1)-grams. The root has arcs to the 1-grams, and one of weight `unknown` to itself."""

    keys: list[np.ndarray]
    weight: list[np.ndarray]
    failure: list[np.ndarray]
    suffix: list[np.ndarray]
    unknown: float

    def step(self, length: np.ndarray, state: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the states (their numbers of tokens, and their places among the n-grams of that many) over the words:
        the new states, and the weight of the arcs taken."""
        most = len(self.keys) - 2
        length, state, weight, open_ = length.copy(), state.copy(), np.zeros(len(words)), np.ones(len(words), dtype=bool)
        new_length, new_state = np.zeros_like(length), np.zeros_like(state)
        for m in range(most, -1, -1):
            here = np.flatnonzero(open_ & (length == m))
            if not len(here):
                continue
            arcs = self.keys[m + 1]
            wanted = longer(self.keys[m][state[here]] if m else words[here], words[here], m + 1)
            k = np.minimum(np.searchsorted(arcs, wanted), max(len(arcs) - 1, 0))
            has = arcs[k] == wanted if len(arcs) else np.zeros(len(here), dtype=bool)
            to, k, lost = here[has], k[has], here[~has]
            weight[to] += self.weight[m + 1][k]
            new_length[to], new_state[to] = min(m + 1, most), k if m < most else self.suffix[m + 1][k] if m else 0
            open_[to] = False
            if m:
                weight[lost] += self.failure[m][state[lost]]
                state[lost] = self.suffix[m][state[lost]]
                length[lost] = m - 1
            else:
                weight[lost] += self.unknown
                open_[lost] = False
        return new_length, new_state, weight

    def read(self, tokens: np.ndarray, starts: np.ndarray, lane: int = 256) -> np.ndarray:
        """Log10 probability of each text. The texts are cut into lanes, read side by side; a lane that is not the
        first of its text reads as many tokens before it as a state holds without adding their weights, which
        brings it to the state in which one reader of the whole text would come there."""
        most = len(self.keys) - 2
        first = np.concatenate([np.arange(a + 1, b, lane) for a, b in zip(starts[:-1], starts[1:], strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        doc = np.searchsorted(starts, first, "right") - 1
        begin, end = np.maximum(first - most, starts[doc] + 1), np.minimum(first + lane, starts[doc + 1])
        length, state, total = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.zeros(len(first))
        if most:  # a reader that starts with its text is in the state of its beginning
            k = int(np.searchsorted(self.keys[1], longer(BEGIN, np.array([BEGIN]), 1)[0]))
            if k < len(self.keys[1]) and self.keys[1][k] == longer(BEGIN, np.array([BEGIN]), 1)[0]:
                length[begin == starts[doc] + 1], state[begin == starts[doc] + 1] = 1, k
        for t in range(int((end - begin).max(initial=0))):
            on = np.flatnonzero(begin + t < end)
            at = begin[on] + t
            length[on], state[on], weight = self.step(length[on], state[on], tokens[at])
            total[on] += np.where(at >= first[on], weight, 0)
        return np.bincount(doc, total, len(starts) - 1)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(
    docs: DataFrame, order: int = 4, mu: Sequence[float] = (16.0, 4.0, 1.0), held_out: tuple[int, int] = (7, 2), doc_id: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20,
) -> DataFrame:
    """Learns from the rows whose crc32(id as text) mod held_out[0] is not held_out[1], and scores all by n-grams of up
    to `order` tokens; mu: for 2, 3, .. tokens (the last one for all longer ones).

    Returns doc_id, held_out, n_tokens (words and the end), n_known (tokens seen in training),
    train_tokens, base_score (the unigrams alone) and score (log10 probability of the text by the
    automaton). Null and empty texts are an end alone. Null ids are not held out. Repeated rows are
    counted and scored as rows of their own; other columns are not read; no rows give no rows. Words of
    single tokens are told apart by 52 bits of a hash or more, longer n-grams by 40 or more: of 2 * 10^6 in
    a bucket, about one in 30,000 meets another and is counted with it.
    """
    modulus, part = held_out
    blocks = make_blocks(docs, doc_id, text, block_bytes)

    def keys_of(ids: list, texts: list[bytes]) -> dict:
        tokens, starts = token_hashes(texts)
        learns = np.repeat(fold_of(ids, modulus) != part, np.diff(starts))
        return {n: distinct_keys(keys, learns[at]) for n, (at, keys) in enumerate(ngram_keys(tokens, starts, order), 1)}

    counts = count_keys(blocks, keys_of, {n: 48 if n == 1 else 36 for n in range(1, order + 1)})
    n_distinct, n_all = counts.totals().get(1, (0, 0))

    def score(ids: list, texts: list[bytes], told) -> pd.DataFrame:
        tokens, starts = token_hashes(texts)
        fold = fold_of(ids, modulus)
        ends = starts[1:] - 1
        scored = np.ones(len(tokens), dtype=bool)
        scored[starts[:-1]] = False
        machine, out = Automaton([np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0)], [np.zeros(0, np.int64)], 0.0), {}
        number = known = c = p = None  # of the n-grams one token shorter: each place's, which of them are known, counts, probabilities
        for n, (at, keys) in enumerate(ngram_keys(tokens, starts, order), 1):
            distinct, one, back = np.unique(keys, return_index=True, return_inverse=True)
            one, count = at[one], told(n, distinct).astype(np.float64)
            if n == 1:
                begins = count[back[ends[0]]]  # there are as many begins as ends, and no begin is a token
                n_tokens, n_words = n_all - begins, n_distinct - (begins > 0)
                prob = (count + 1) / (n_tokens + n_words + 1)
                machine.unknown = float(np.log10(1 / (n_tokens + n_words + 1)))
                text_of = np.repeat(np.arange(len(ids)), np.diff(starts))
                out["n_known"] = np.bincount(text_of, scored & (count[back] > 0), len(ids)).astype(np.int64)
                out["base_score"] = np.bincount(text_of, np.where(scored, np.log10(prob)[back], 0), len(ids))
                below = np.zeros(len(distinct), dtype=np.int64)
            else:
                weight = float(mu[min(n - 2, len(mu) - 1)])
                context, below = number[one - 1], number[one]
                prob = (count + weight * p[below]) / (c[context] + weight)
                machine.failure.append(np.log10(weight / (c[known] + weight)))  # of the states one token shorter
                below = (np.cumsum(known) - 1)[below]
            c, p, known = count, prob, count > 0
            number = np.zeros(len(tokens), dtype=np.int64)
            number[at] = back
            machine.keys.append(distinct[known])
            machine.weight.append(np.log10(prob[known]))
            machine.suffix.append(below[known])
        result = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "held_out": fold == part, "n_tokens": np.diff(starts) - 1, "train_tokens": int(n_tokens) if len(ids) else 0, **out, "score": machine.read(tokens, starts)})
        return result[[c.split()[0] for c in SCORES.split(", ")]]

    return for_each_block(blocks, counts, score, SCORES)
