"""The mask solver in the row: a document's open tokens are decided where its words are, no token is moved."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stratalex.functions import text as ft

TAGS = ["OTHER", "PREP", "CONJ", "ADV", "DET", "VERB", "ADJ", "NOUN"]
KINDS = ["word_level", "ambiguous", "unigram", "prior", "sole", "zero"]
#: Tokens that are looked at at once; a document is never cut.
AT_ONCE = 1 << 19


@dataclass
class Rules:
    """The solver's fixed values; ``most`` is None where all words of a skeleton are candidates."""

    veto: float
    own: float
    prior: float
    name: int
    unigram: int
    unigram_segments: int
    unigram_ratio: float
    sole_segments: int
    sole_score: float
    fields: int
    most: int | None


def _lists(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, distinct keys, bounds) of a table of lists by key."""
    order = np.argsort(keys, kind="stable")
    kinds, first = np.unique(keys[order], return_index=True)
    return order, kinds, np.append(first, len(keys))


def _laid_out(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of all entries of ranges that begin at ``first``."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def _grouped(change: np.ndarray) -> np.ndarray:
    """Where groups begin, of sorted rows whose key is ``change``."""
    return np.flatnonzero(np.r_[True, change[1:] != change[:-1]]) if len(change) else np.zeros(0, np.int64)


class Reference:
    """Dictionary, pairs and classes as arrays. Words are numbered in their order, so ties by word are ties by number.

    ``words`` has (word, freq, skel, cs, field, tag, verb, adj, noun), the last three whether its ending fits that class;
    ``pairs`` (w1, w2, p) and ``tags`` (t1, t2, p).
    """

    def __init__(self, words: Iterable[tuple], pairs: Iterable[tuple], tags: Iterable[tuple], rules: Rules) -> None:
        rows = sorted(words)
        self.rules = rules
        number = {r[0]: i for i, r in enumerate(rows)}
        self.words = pa.array(list(number), pa.string())
        self.size = len(rows)
        self.freq = np.array([r[1] for r in rows], float)
        self.cs = np.array([r[3] for r in rows], float)
        self.field = np.array([-1 if r[4] is None else r[4] for r in rows], np.int64)
        self.tag = np.array([TAGS.index(r[5]) for r in rows], np.int64)
        self.long = np.array([len(w) >= rules.name for w in number], bool)
        self.fits = np.array([[True] * len(rows), *([r[k] for r in rows] for k in (6, 7, 8))], bool).reshape(4, -1)
        self.skels = sorted({r[2] for r in rows if r[2]})
        self.joined = pa.array([s.replace("-", "") for s in self.skels], pa.string())
        of = {s: i for i, s in enumerate(self.skels)}
        self.skel = np.array([of.get(r[2], -1) for r in rows], np.int64)
        self.segments = np.array([s.count("-") + 1 for s in self.skels], np.int64)
        own = np.flatnonzero(self.skel >= 0)
        self.own = own[np.argsort(self.skel[own], kind="stable")]
        self.count = np.bincount(self.skel[own], minlength=len(self.skels)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.asked = self.count > 0 if rules.most is None else self.count <= rules.most
        self.odds = np.zeros((len(TAGS), len(TAGS)))
        for a, b, p in tags:
            self.odds[TAGS.index(a), TAGS.index(b)] = p
        known = [(number[a], number[b], p) for a, b, p in pairs]
        w1, w2 = (np.array([x[k] for x in known], np.int64) for k in (0, 1))
        p = np.array([x[2] for x in known], float)
        self.sides = [self._side(w1, w2, p), self._side(w2, w1, p)]

    def _side(self, beside: np.ndarray, word: np.ndarray, p: np.ndarray) -> tuple:
        """The words of a skeleton that are known beside a word, with p."""
        has = self.skel[word] >= 0 if len(word) else np.zeros(0, bool)
        beside, word, p = beside[has], word[has], p[has]
        order, kinds, bounds = _lists(beside * len(self.skels) + self.skel[word])
        return kinds, bounds, word[order], p[order]

    def known_beside(self, side: int, beside: np.ndarray, skel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, p) of the pairs of each row's word beside (-1: none) with a word of its skeleton."""
        kinds, bounds, word, p = self.sides[side]
        key = beside * len(self.skels) + skel
        at = np.searchsorted(kinds, key)
        hit = np.flatnonzero((beside >= 0) & (at < len(kinds)))
        hit = hit[kinds[at[hit]] == key[hit]]
        owner, place = _laid_out(bounds[at[hit]], bounds[at[hit] + 1] - bounds[at[hit]])
        return hit[owner], word[place], p[place]

    def codes(self, tokens: pa.Array) -> np.ndarray:
        """A number a token: that of its word if the dictionary has it, -1 without candidates, else -2 less four times its skeleton and the class that endings must fit."""
        coded = tokens.dictionary_encode()
        kinds = coded.dictionary.cast(pa.string())
        out = pc.fill_null(pc.index_in(kinds, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        open_ = np.flatnonzero(out < 0)
        some = kinds.take(pa.array(open_))
        made = pc.replace_substring_regex(some, f"[^{''.join(ft.LATIN_CLASSES)}]", "")
        for sign in dict.fromkeys(ft.LATIN_CLASSES.values()):
            made = pc.replace_substring_regex(made, "[" + "".join(k for k, v in ft.LATIN_CLASSES.items() if v == sign) + "]+", sign)
        skel = pc.fill_null(pc.index_in(made, value_set=self.joined), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        closed = pc.is_in(some, value_set=pa.array([*ft.PREPOSITIONS, *ft.CONJUNCTIONS, *ft.ADVERBS, *ft.DETERMINERS]))
        ends = lambda xs: pc.match_substring_regex(some, f"({'|'.join(xs)})$").to_numpy(zero_copy_only=False)
        long = pc.greater(pc.utf8_length(some), 3).to_numpy(zero_copy_only=False)
        kind = np.select([closed.to_numpy(zero_copy_only=False), long & ends(ft.VERB_ENDINGS), long & ends(ft.ADJECTIVE_ENDINGS)], [0, 1, 2], 3)
        out[open_] = np.where(skel >= 0, -2 - (4 * skel + kind), -1)
        return out[coded.indices.to_numpy(zero_copy_only=False)]


@dataclass
class Texts:
    """Some documents, one behind the other: where each token's document begins and ends, its field (-1: none that words have, -2: no id), its code and its word (-1: open)."""

    start: np.ndarray
    end: np.ndarray
    field: np.ndarray
    code: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, fields: np.ndarray, code: np.ndarray, word: np.ndarray | None = None) -> Texts:
        ends = np.cumsum(sizes)
        return cls(np.repeat(ends - sizes, sizes), np.repeat(ends, sizes), np.repeat(fields, sizes), code, np.where(code >= 0, code, -1) if word is None else word)

    def open_(self, asked: np.ndarray, beside: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(at, skeleton, class, left word, gap, right word, gap) of the open tokens of ``asked`` skeletons; no word is -1, and its gap is far. With ``beside`` only those next to one of these places, which are in order and found."""
        here = np.arange(len(self.code))
        left = np.maximum.accumulate(np.where(self.word >= 0, here, -1)) if len(here) else here
        right = np.minimum.accumulate(np.where(self.word >= 0, here, len(here))[::-1])[::-1] if len(here) else here
        at = np.flatnonzero((self.word < 0) & (self.code < -1) & (self.field > -2))
        if beside is not None:
            new = np.zeros(len(here) + 1, bool)
            new[beside] = True
            at = at[new[left[at]] | new[right[at]]]
        skel, kind = np.divmod(-2 - self.code[at], 4)
        some = asked[skel]
        at, skel, kind = at[some], skel[some], kind[some]
        l, r = left[at], right[at]
        has_l, has_r = l >= self.start[at], r < self.end[at]
        far = np.iinfo(np.int64).max
        word = lambda i, has: np.where(has, self.word[np.where(has, i, 0)], -1)
        return at, skel, kind, word(l, has_l), np.where(has_l, at - l, far), word(r, has_r), np.where(has_r, r - at, far)


def decided(ref: Reference, texts: Texts, settings: Iterable[tuple[float, float]] = ((5.0, 0.6),), beside: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(at, [(kind, word), ...]): the open tokens that have candidates, and how they are decided under each of ``settings`` (ratio, near): one whole pass.

    What depends on classes and the field alone is found once for each token's skeleton, class, class before it and
    field; scores once for each of these between two words, from known pairs alone.
    """
    rules = ref.rules
    at, skel, kind, left, left_gap, right, right_gap = texts.open_(ref.asked, beside)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, [(none, none) for _ in settings]
    fields = rules.fields + 1
    ltag = np.where(left >= 0, ref.tag[left] + 1, 0)
    field = np.where(texts.field[at] >= 0, texts.field[at], rules.fields)
    keys, group = np.unique(((skel * 4 + kind) * (len(TAGS) + 1) + ltag) * fields + field, return_inverse=True)
    rest, g_field = np.divmod(keys, fields)
    rest, g_ltag = np.divmod(rest, len(TAGS) + 1)
    g_skel, g_kind = np.divmod(rest, 4)
    g, place = _laid_out(ref.first[g_skel], ref.count[g_skel])
    w = ref.own[place]

    def where_any(g: np.ndarray, fine: np.ndarray) -> np.ndarray:
        some = np.bincount(g[fine], minlength=len(keys)) > 0
        return fine | ~some[g]

    keep = where_any(g, ref.fits[g_kind[g], w])
    g, w = g[keep], w[keep]
    keep = where_any(g, (g_ltag[g] == 0) | (ref.odds[np.maximum(g_ltag[g] - 1, 0), ref.tag[w]] >= rules.veto))
    g, w = g[keep], w[keep]
    mine = ref.field[w] == g_field[g]
    named = mine & ref.long[w]
    begins = _grouped(g)
    sole, sole_cs = w[begins], np.minimum.reduceat(ref.cs[w], begins)
    # by frequency
    often = np.flatnonzero(ref.freq[w] >= rules.unigram)
    uni = ref.freq[w[often]] * np.where(named[often], rules.prior, 1.0)
    order = np.lexsort((w[often], -uni, g[often]))
    often, uni = often[order], uni[order]
    us_first, us_second, us_word, us = (np.zeros(len(keys)) for _ in range(4))
    us = np.bincount(g[often], minlength=len(keys))
    b = _grouped(g[often])
    us_first[g[often[b]]], us_word[g[often[b]]] = uni[b], w[often[b]]
    two = b[us[g[often[b]]] > 1]
    us_second[g[often[two]]] = uni[two + 1]
    # by name
    ns = np.bincount(g[named], minlength=len(keys))
    n_word = np.zeros(len(keys), np.int64)
    b = _grouped(g[named])
    n_word[g[named][b]] = w[named][b]
    # by the words beside
    wide = ref.size + 1
    contexts, context = np.unique((group * wide + left + 1) * wide + right + 1, return_inverse=True)
    rest, c_right = np.divmod(contexts, wide)
    c_group, c_left = np.divmod(rest, wide)
    parts = [ref.known_beside(side, beside - 1, g_skel[c_group]) for side, beside in ((0, c_left), (1, c_right))]
    c, x, p = (np.concatenate(y) for y in zip(*parts))
    order = np.argsort(c * ref.size + x, kind="stable")
    c, x, p = c[order], x[order], p[order]
    b = _grouped(c * ref.size + x)
    s = np.add.reduceat(p, b) if len(b) else p
    c, x = c[b], x[b]
    may = g * ref.size + w
    asked = c_group[c] * ref.size + x
    place = np.searchsorted(may, asked)
    hit = np.flatnonzero(place < len(may))
    hit = hit[may[place[hit]] == asked[hit]]
    c, x, s, place = c[hit], x[hit], s[hit], place[hit]
    worth = s * np.where(mine[place], rules.own, 1.0) * np.where(named[place], rules.prior, 1.0)
    order = np.lexsort((x, -worth, c))
    c, x, worth, boosted = c[order], x[order], worth[order], named[place[order]]
    nonzero = np.bincount(c, minlength=len(contexts))
    best, second = np.zeros(len(contexts)), np.zeros(len(contexts))
    best_word, best_named = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), bool)
    b = _grouped(c)
    best[c[b]], best_word[c[b]], best_named[c[b]] = worth[b], x[b], boosted[b]
    two = b[nonzero[c[b]] > 1]
    second[c[two]] = worth[two + 1]

    seg = ref.segments[skel]
    b1, b2, some = best[context], second[context], nonzero[context]
    close, dual = (left_gap <= 2) | (right_gap <= 2), (left_gap <= 3) & (right_gap <= 3)
    scale = np.where(some == 2, 0.75, np.where(some <= 5, 0.9, 1.0))
    half = np.where(best_named[context], 0.5, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        lead = np.where(b2 > 0, b1 / b2, np.inf)
        u_lead = us_first / us_second
    names = (ns[group] == 1) & (seg >= 2)
    alone = (ref.count[skel] == 1) & (seg >= rules.sole_segments) & (sole_cs[group] > rules.sole_score)
    found = []
    for ratio, near in settings:
        base = np.where(seg >= 5, min(3.0, ratio), ratio)
        need = np.maximum(base * scale * np.where(dual, near, 1.0) * half, 1.5)
        clear = (us[group] == 1) | (u_lead[group] >= base * rules.unigram_ratio)
        by = np.select([(b1 > 0) & (lead >= need), b1 > 0, (us[group] > 0) & (seg >= rules.unigram_segments) & close & clear, names, alone], [0, 1, 2, 3, 4], 5)
        word = np.choose(by, [best_word[context], -1, us_word[group].astype(np.int64), n_word[group], sole[group], -1])
        found.append((by, word))
    return at, found


class Backoffs:
    """What is decided by classes and by letters, over skeletons of three segments or more and ``most`` words at most."""

    def __init__(self, ref: Reference, most: int) -> None:
        self.ref = ref
        self.asked = (ref.segments >= 3) & (ref.count <= most)
        #: The word of each skeleton whose letters have a clear lead, or are likely and alone.
        self.leads = np.full(len(ref.skels), -1, np.int64)
        for s in np.flatnonzero(self.asked):
            own = ref.own[ref.first[s] : ref.first[s] + ref.count[s]]
            own = own[np.lexsort((own, -ref.cs[own]))]
            if (len(own) == 1 and ref.cs[own[0]] > -8) or (len(own) > 1 and ref.cs[own[0]] - ref.cs[own[1]] >= 0.5):
                self.leads[s] = own[0]

    def by_classes(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(at, word) within three places of words on both sides whose best candidate leads five times."""
        ref = self.ref
        at, skel, _, left, left_gap, right, right_gap = texts.open_(self.asked)
        near = (left_gap <= 3) & (right_gap <= 3)
        at, skel, left, right = at[near], skel[near], left[near], right[near]
        if not len(at):
            return at, at
        n = len(TAGS)
        keys, group = np.unique((skel * n + ref.tag[left]) * n + ref.tag[right], return_inverse=True)
        rest, rt = np.divmod(keys, n)
        g_skel, lt = np.divmod(rest, n)
        g, place = _laid_out(ref.first[g_skel], ref.count[g_skel])
        w = ref.own[place]
        s = 0.1 * (ref.odds[lt[g], ref.tag[w]] + ref.odds[ref.tag[w], rt[g]])
        order = np.lexsort((w, -s, g))
        g, w, s = g[order], w[order], s[order]
        b = _grouped(g)
        more = ref.count[g_skel] > 1
        second = np.where(more, s[np.minimum(b + 1, len(s) - 1)], 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            word = np.where((s[b] > 0) & ((second == 0) | (s[b] / second >= 5)), w[b], -1)[group]
        return at[word >= 0], word[word >= 0]

    def by_letters(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(at, word) within four places of a word."""
        at, skel, _, _, left_gap, _, right_gap = texts.open_(self.asked)
        word = np.where((left_gap <= 4) | (right_gap <= 4), self.leads[skel], -1)
        return at[word >= 0], word[word >= 0]


def cut(sizes: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of runs of rows of ``most`` tokens, or of one row."""
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield first, len(sizes)


def texts_of(ref: Reference, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Texts]]:
    """(sizes, fields, texts) of documents (doc_id, toks), some at a time."""
    for batch in batches:
        lists, ids = batch.column("toks"), batch.column("doc_id")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        field = np.fmod(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64), ref.rules.fields)
        field = np.where(pc.is_null(ids).to_numpy(zero_copy_only=False), -2, np.maximum(field, -1))
        for i, j in cut(sizes):
            yield sizes[i:j], field[i:j], Texts.of(sizes[i:j], field[i:j], ref.codes(lists.slice(i, j - i).flatten()))


class Counts:
    """How often each word (or none) comes under some labels, added up by a task."""

    def __init__(self, labels: int, words: int) -> None:
        self.labels, self.n = labels, np.zeros((labels, words + 1), np.int64)

    def add(self, label: np.ndarray, word: np.ndarray) -> None:
        wide = self.n.shape[1]
        self.n += np.bincount(label * wide + word + 1, minlength=self.labels * wide).reshape(self.n.shape)

    def batch(self) -> pa.RecordBatch:
        label, word = np.nonzero(self.n)
        cols = [pa.array(label, pa.int32()), pa.array(np.where(word > 0, word - 1, 0), pa.int32(), mask=word == 0), pa.array(self.n[label, word], pa.int64())]
        return pa.record_batch(cols, names=["label", "word", "n"])


COUNTED = "label int, word int, n long"


def counted_kinds(held) -> Callable:
    """Tokens by how one pass decides them, and word."""

    def run(batches):
        ref = held.value
        counts = Counts(len(KINDS), ref.size)
        for _, _, texts in texts_of(ref, batches):
            _, [(kind, word)] = decided(ref, texts)
            counts.add(kind, word)
        yield counts.batch()

    return run


def counted_settings(held, settings: list[tuple[float, float]]) -> Callable:
    """Tokens that have candidates, and those decided, under each setting: the word of a row is 0 for those found."""

    def run(batches):
        ref = held.value
        counts = Counts(len(settings), 1)
        for _, _, texts in texts_of(ref, batches):
            for k, (_, word) in enumerate(decided(ref, texts, settings)[1]):
                counts.add(np.full(len(word), k), np.where(word >= 0, 0, -1))
        yield counts.batch()

    return run


def counted_passes(held, passes: int) -> Callable:
    """Tokens by the pass that found them and word: 0 is known before, the last label open. Passes of a document see no other, so all are made where it is."""

    def run(batches):
        ref = held.value
        counts = Counts(passes + 2, ref.size)
        for _, _, texts in texts_of(ref, batches):
            step = np.where(texts.word >= 0, 0, passes + 1)
            at = None
            for k in range(1, passes + 1):
                # what no word is new beside is decided as in the pass before
                at, [(_, word)] = decided(ref, texts, beside=at)
                at, word = at[word >= 0], word[word >= 0]
                if not len(at):
                    break
                texts.word[at], step[at] = word, k
            counts.add(step, texts.word)
        yield counts.batch()

    return run


#: Documents between rounds: field, codes of their tokens, their words, and when and by what each was found.
STATE = "field int, code array<int>, word array<int>, mark array<int>"
#: What a token was found by; a mark is eight times the step and one of these, and -1 while it is open.
BY = ["known", "solver", "consensus", "classes", "letters"]


def _state(sizes, fields, texts, mark) -> pa.RecordBatch:
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    cols = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (texts.code, texts.word, mark)]
    return pa.record_batch([pa.array(fields, pa.int32()), *cols], names=["field", "code", "word", "mark"])


def _from_state(batches) -> Iterator[tuple[np.ndarray, np.ndarray, Texts, np.ndarray]]:
    for batch in batches:
        sizes = pc.list_value_length(batch.column("code")).to_numpy(zero_copy_only=False).astype(np.int64)
        fields = batch.column("field").to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in cut(sizes):
            code, word, mark = (batch.column(c).slice(i, j - i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("code", "word", "mark"))
            yield sizes[i:j], fields[i:j], Texts.of(sizes[i:j], fields[i:j], code, word), mark


def _solve(ref, texts, mark, step):
    at, [(_, word)] = decided(ref, texts)
    at, word = at[word >= 0], word[word >= 0]
    texts.word[at], mark[at] = word, 8 * step + BY.index("solver")


def begun(held) -> Callable:
    """The state of documents (doc_id, toks) after the first pass of the solver."""

    def run(batches):
        ref, _ = held.value
        for sizes, fields, texts in texts_of(ref, batches):
            mark = np.where(texts.word >= 0, 0, -1)
            _solve(ref, texts, mark, 1)
            yield _state(sizes, fields, texts, mark)

    return run


def gone_on(held, agreed: list[int], step: int, last: bool) -> Callable:
    """The state after the rest of round ``step``, consensus (``agreed``: a word a skeleton, or -1), classes and letters, and after the solver of the next one but for the ``last``."""

    def run(batches):
        ref, back = held.value
        said = np.array(agreed, np.int64)
        for sizes, fields, texts, mark in _from_state(batches):
            at = np.flatnonzero((texts.word < 0) & (texts.code < -1) & (texts.field > -2))
            word = said[(-2 - texts.code[at]) // 4]
            for by, found in (("consensus", lambda t: (at[word >= 0], word[word >= 0])), ("classes", back.by_classes), ("letters", back.by_letters)):
                where, words = found(texts)
                texts.word[where], mark[where] = words, 8 * step + BY.index(by)
            if not last:
                _solve(ref, texts, mark, step + 1)
            yield _state(sizes, fields, texts, mark)

    return run


def counted_state(batches):
    """(mark, skel, word, n) of a state's tokens, added up by a task; the skeleton is that of a found token, else -1."""
    total: dict[tuple[int, int, int], int] = {}
    for _, _, texts, mark in _from_state(batches):
        skel = np.where((texts.code < -1) & (texts.word >= 0), (-2 - texts.code) // 4, -1)
        kinds, n = np.unique(np.stack([mark, skel, texts.word]), axis=1, return_counts=True)
        for key, m in zip(map(tuple, kinds.T.tolist()), n.tolist()):
            total[key] = total.get(key, 0) + m
    cols = [pa.array([k[i] for k in total], pa.int32()) for i in range(3)] + [pa.array(total.values(), pa.int64())]
    yield pa.record_batch(cols, names=["mark", "skel", "word", "n"])


STATE_COUNTED = "mark int, skel int, word int, n long"
