"""Personal data: patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, flat, lean, map_texts, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N = len(LABELS)
STEPS, RATE, DECAY, MOVE = 200, 0.08, 2e-4, 3.0

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no digit can stand before: a match that fails at a run of digits fails within it too
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by start and then kind; matches that fail a kind's test are dropped."""
    if not _ANY.search(text):
        return []
    out, end, before = [], 0, 0
    at = text.find("@")
    while at >= 0:
        lo = max(end, before)  # a local part holds no @ and nothing of the match before
        begin = lo + len(text[lo:at].rstrip(_LOCAL)) if at >= lo else at
        if at >= lo and begin < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", begin, m.end()))
            end = m.end()
        before = at + 1
        at = text.find("@", at + 1)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


# ---- the field -------------------------------------------------------------------------------------------

#: Features of a word without digit, @ or +: several, so that the penalty holds them back less and such words lead
#: for O by more than a move can cost.
PLAIN = ("plain", "plain 2", "plain 3", "plain 4")


#: Words that say what a number beside them is: one to reach a person at, or one that counts or names a thing.
CUES = {
    "reached": "call cell contact dial fax faxed handy hotline kontakt mobil mobile móvil phone ring rufnummer sms telefax telefon telefono teléfono telephone tel text tél téléphone whatsapp".split(),
    "counted": "account amount article asin balance barcode batch bitcoin block build case catalog chapter code codes contract count customer date dated distance docket ean height iban id index invoice isbn issn issue item items "
    "km konto length licence license line lot mass measured model models nr order page pages parcel part parts patent pin policy pop population postcode price product quantity range rate ratio record ref reference "
    "row rows sample samples score section sequence serial series size sku sum table ticket timestamp total totals tracking upc value values version vin volume weight zip".split(),
}
_CUE_OF = {w: kind for kind, words in CUES.items() for w in words}


@lru_cache(1 << 16)
def plain_feature(word: str) -> str:
    """What a word without digit, @ or + shows to neighbours that have one; to others it is plain (features_of)."""
    return _CUE_OF.get(word.strip("\"'.,;:!?#$%&*|<>[](){}").lower(), "plain")


@lru_cache(1 << 16)
def shape(word: str) -> str:
    """A word's shape: digits become 0, letters A or a, and each keeps its length; other characters stay."""
    return "".join("0" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)


@lru_cache(1 << 16)
def shape_features(form: str) -> tuple[str, ...]:
    """Names of what a shape with a digit, @ or + shows."""
    core = form.strip("\"'.,;:!?#$%&*|<>[]{}")
    n = core.count("0")
    squeezed = re.sub(r"0+", "0", re.sub(r"[Aa]+", "a", core))
    signs = "".join(sorted(set(re.sub(r"[0Aa]", "", core))))[:6]
    return (
        "any", f"digits {min(n, 20)}", f"runs {re.sub('[^ 0-9a+()@.-]', '?', squeezed)[:24]}", f"signs {signs}", f"letters {min(len(re.findall('[Aa]+', core)), 4)}",
        f"first {core[:1]}", f"only {bool(re.fullmatch('[0 ().+-]+', core))}", f"groups {'-'.join(str(min(len(x), 7)) for x in re.findall('0+', core)[:6])}", f"at {'@' in core and '.' in core.rsplit('@')[-1]}",
    )


def near_feature(form: str | None) -> str:
    """What a word shows to its neighbours."""
    if form is None:
        return "edge"
    core = form.strip("\"'.,;:!?#$%&*|<>[]{}")
    return f"{min(core.count('0'), 6)}{'+' if '+' in core else ''}{'(' if '(' in core else ''}{'@' if '@' in core else ''}"


def is_plain(word: str) -> bool:
    return not any("0" <= c <= "9" or c in "@+" for c in word)


def features_of(form: str | None, before: str, after: str) -> list[str]:
    """Feature names of a word: of its shape (None: a plain word), and what its neighbours show. Cues are for words with digits only, so
    that plain words lead for O by the same margin beside them."""
    if form is None:
        return [*PLAIN, *(f"{side} {'plain' if x in CUES else x}" for side, x in (("before", before), ("after", after)))]
    return [*shape_features(form), f"before {before}", f"after {after}"]


def names_of(words: list[str]) -> list[list[str]]:
    """Feature names of each word of a sentence."""
    forms = [None if is_plain(w) else shape(w) for w in words]
    near = [plain_feature(w) if f is None else near_feature(f) for w, f in zip(words, forms)]
    near = ["edge", *near, "edge"]
    return [features_of(f, near[k], near[k + 2]) for k, f in enumerate(forms)]


@dataclass
class Field:
    index: dict[str, int]
    emit: np.ndarray  # features x labels; the last row is of unknown features, zero
    move: np.ndarray  # label x next label
    begin: np.ndarray

    def emissions(self, names: Iterable[list[str]]) -> np.ndarray:
        return np.array([self.emit[[self.index.get(n, -1) for n in own]].sum(axis=0) for own in names]).reshape(-1, N)

    @property
    def reach(self) -> int | None:
        """Words without digit, @ or + that are farther than this from any other word are O on the best path.

        Such words lead for O by some least margin. A run of r other labels on them pays r margins and gains r + 1 moves at
        most; with O it has moves from O to O, and at an end where the run went on any move at worst. From some r on the
        O's are better, and for runs that end within they must always be. None if the weights don't show this."""
        ends = ("plain", "edge")
        e = self.emissions([[*PLAIN, f"before {a}", f"after {b}"] for a in ends for b in ends])
        lead = float((e[:, 0] - e[:, 1:].max(axis=1)).min())
        moves = np.concatenate([self.move.ravel(), self.begin])
        high, low, stay = float(moves.max()), float(moves.min()), float(min(self.move[0, 0], self.begin[0]))
        gain = lead - high + stay
        if gain <= 0 or lead <= 2 * (high - stay):
            return None
        return max(1, int(np.floor((high + stay - 2 * low) / gain)) + 1)


def training_table(seed: int = 5, rows: int = 640) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences with personal data in forms that the patterns miss and find, and with numbers that are
    none: dates and times, order, invoice and part numbers, book numbers, account numbers, versions, amounts, places, bare groups of
    digits. Forms of phones after a word that counts or names a thing (CUES) are none, and bare groups are one only after a word that
    says so."""
    rng = np.random.default_rng(seed)

    def d(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    def pick(*x):
        return x[int(rng.integers(len(x)))]

    def word():
        return "".join(pick(*"abdefghilmnoprstuv") for _ in range(int(rng.integers(2, 9))))

    def octet():
        return str(rng.integers(0, 256))

    def two(low, high):
        return f"{rng.integers(low, high):02d}"

    def date(sep):
        return f"{rng.integers(1900, 2031)}{sep}{two(1, 13)}{sep}{two(1, 29)}"

    def card(*sizes):
        sizes = list(sizes)
        while not luhn(own := pick("3", "4", "5") + d(sum(sizes) - 1)):
            pass
        at = np.cumsum([0, *sizes])
        return [own[a:b] for a, b in zip(at, at[1:])]

    private = {
        "email": [lambda: f"{word()}@{word()}.com", lambda: f"{word()}.{d(2)}@{word()}{d(1)}.{word()}.org", lambda: f"{word()}_{word()}@{word()}.co.uk", lambda: f"{word()} @ {word()}.net", lambda: f"{word()}{d(2)} @ {word()}.{word()}.org"],
        "ip": [lambda: ".".join(octet() for _ in range(4)), lambda: ".".join(octet() for _ in range(4)) + ":" + d(4)],
        "card": [lambda: "".join(card(16)), lambda: " ".join(card(4, 4, 4, 4)), lambda: "-".join(card(4, 4, 4, 4)), lambda: " ".join(card(4, 6, 5)), lambda: ".".join(card(4, 4, 4, 4))],
        "phone": [
            lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+{d(2)} {d(2)} {d(4)} {d(4)}",
            lambda: f"+{d(2)}{d(9)}", lambda: f"({d(3)}){d(3)}-{d(4)}", lambda: f"+{d(2)}-{d(3)}-{d(3)}-{d(4)}", lambda: f"00{d(2)} {d(2)} {d(3)} {d(2)} {d(2)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"00{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}",
            lambda: f"0{d(3)}/{d(7)}", lambda: f"(0{d(2)}) {d(4)} {d(4)}",
        ],
    }
    harmless = [
        lambda: str(rng.integers(1, 3000)), lambda: f"{rng.integers(1900, 2030)}", lambda: date("-"), lambda: date("/"), lambda: f"{two(1, 29)}/{two(1, 13)}/{d(4)}", lambda: f"{two(1, 29)}.{two(1, 13)}.{d(4)}", lambda: f"{date('-')} {two(0, 24)}:{two(0, 60)}", lambda: f"{date('-')}T{two(0, 24)}:{two(0, 60)}:{two(0, 60)}",
        lambda: f"{d(1)}.{d(2)}", lambda: f"${d(2)}.{d(2)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}%", lambda: f"#{d(5)}", lambda: f"#{d(10)}", lambda: f"{word()}{d(2)}", lambda: f"@{word()}", lambda: f"{word()}+{word()}",
        lambda: f'"{"".join(pick(*"0123456789abcdef") for _ in range(40))}"', lambda: f"{pick('password', 'token', 'key')}={''.join(pick(*'0123456789abcdef') for _ in range(18))}", lambda: f"https://{word()}.com/{d(6)}", lambda: f"{d(2)} x {d(2)}", lambda: f"{d(3)} {d(3)}", lambda: f"({d(4)})", lambda: d(6), lambda: d(8),
        lambda: d(10), lambda: d(13), lambda: f"[{d(2)}]", lambda: f"{d(2)}-{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f"{rng.integers(1990, 2031)}-{d(2)}-{d(4)}", lambda: f"{rng.integers(1990, 2031)}-{d(5)}", lambda: f"{word().upper()}-{d(4)}-{d(3)}", lambda: f"{word().upper()[:2]}{d(8)}",
        lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"GB{d(2)} NWBK {d(4)} {d(4)} {d(4)} {d(2)}", lambda: f"DE{d(20)}", lambda: f"{d(2)}.{d(4)}, {d(2)}.{d(4)}", lambda: f"{d(5)}-{d(4)}", lambda: f"{d(4)}-{d(4)}", lambda: f"pp. {d(3)}-{d(3)}", lambda: f"{d(3)}/{d(4)}", lambda: f"{d(1)} {d(3)} {d(3)}",
        lambda: f"{d(2)} {d(3)} {d(3)}", lambda: f"{d(3)} + {d(3)} = {d(3)}", lambda: f"{d(2)} @ ${d(1)}.{d(2)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(2)}-{d(2)}-{d(4)}", lambda: f"{rng.integers(1900, 2000)}-{rng.integers(2000, 2030)}",
    ]
    bare = [lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{d(3)} {d(3)} {d(3)} {d(3)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"{d(4)} {d(3)} {d(4)}", lambda: f"{d(3)} {d(8)}", lambda: f"{d(3)} {d(4)} {d(4)}"]

    open_forms = [f for f in private["phone"] if not set("+(") & set(f())]

    def cue(kind):
        own = pick(*CUES[kind])
        return pick(own, own, own.capitalize()) + pick("", "", ":", ".")

    table = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 3))):
            for _ in range(int(rng.integers(0, 6))):
                words.append((word() if rng.random() < 0.75 else cue(pick(*CUES))) + pick("", "", "", ",", ".", "***", "!!", "$$$"))
                labels.append("O")
            if rng.random() < 0.5:
                kind = pick(*KINDS)
                if kind == "phone" and rng.random() < 0.5:
                    words.append(cue("reached"))
                    labels.append("O")
                own = (pick(*private[kind])() + pick("", "", "", ".", ",", "###", "%%%", "!!")).split()
                words += own
                labels += [f"{'I' if k else 'B'}-{kind}" for k in range(len(own))]
            elif rng.random() < 0.25:  # a number to reach someone at by its form, and by the word before it none; or bare groups of digits
                if rng.random() < 0.6:
                    words.append(cue("counted"))
                    labels.append("O")
                    own = pick(*open_forms)().split()
                else:
                    own = pick(*bare)().split()
                labels += ["O"] * len(own)
                words += own
            elif rng.random() < 0.15:  # the same bare groups after a word that says what they are
                words += [cue("reached"), *(own := pick(*bare)().split())]
                labels += ["O", "B-phone", *["I-phone"] * (len(own) - 1)]
            else:
                if rng.random() < 0.3:
                    words.append(cue("counted"))
                    labels.append("O")
                own = (pick(*harmless)() + pick("", "", ".", ",", "***")).split()
                words += own
                labels += ["O"] * len(own)
        table.append((words, labels))
    return table


def train(table: list[tuple[list[str], list[str]]], steps: int = STEPS) -> Field:
    """Maximises the penalised likelihood by Adam, with forward and backward sums over all sentences at once."""
    table = [(w, y) for w, y in table if w]
    names = [names_of(w) for w, _ in table]
    index = {n: k for k, n in enumerate(dict.fromkeys(n for s in names for own in s for n in own))}
    b, t = len(table), max(len(w) for w, _ in table)
    real = np.zeros((b, t), bool)
    gold = np.zeros((b, t), int)
    row, col = [], []
    for i, (s, (_, y)) in enumerate(zip(names, table)):
        real[i, : len(s)] = True
        gold[i, : len(s)] = [LABELS.index(x) for x in y]
        for k, own in enumerate(s):
            row += [i * t + k] * len(own)
            col += [index[n] for n in own]
    seen, row = np.unique(row, return_inverse=True)  # words that are there
    shown = np.zeros((len(seen), len(index) + 1))
    np.add.at(shown, (row, col), 1)  # words x features: the table is small
    parts = [np.zeros((len(index) + 1, N)), np.zeros((N, N)), np.zeros(N)]
    empirical = [np.zeros_like(p) for p in parts]
    empirical[0] = shown.T @ np.eye(N)[gold.ravel()[seen]]
    pairs = real[:, 1:]
    np.add.at(empirical[1], (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    np.add.at(empirical[2], gold[:, 0], 1)
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    for step in range(1, steps + 1):
        emit, move, begin = parts
        e = np.zeros((b * t, N))
        e[seen] = shown @ emit
        e = e.reshape(b, t, N)
        fore, back = np.zeros((b, t, N)), np.zeros((b, t, N))
        fore[:, 0] = begin + e[:, 0]
        for k in range(1, t):
            fore[:, k] = np.where(real[:, k, None], lse(fore[:, k - 1, :, None] + move, 1) + e[:, k], fore[:, k - 1])
        for k in range(t - 2, -1, -1):
            back[:, k] = np.where(real[:, k + 1, None], lse(move + (e[:, k + 1] + back[:, k + 1])[:, None, :], 2), back[:, k + 1])
        z = lse(fore[:, -1], 1)
        p = np.exp(fore + back - z[:, None, None]) * real[:, :, None]
        both = np.exp(fore[:, :-1, :, None] + move + (e[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
        expected = [shown.T @ p.reshape(-1, N)[seen], both.sum(axis=(0, 1)), p[:, 0].sum(axis=0)]
        for k in range(3):
            g = (expected[k] - empirical[k]) / b + DECAY * parts[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            parts[k] = parts[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        parts[1], parts[2] = parts[1].clip(-MOVE, MOVE), parts[2].clip(-MOVE, MOVE)
    parts[0][-1] = 0
    return Field(index, *parts)


def viterbi(field: Field, emissions: np.ndarray, size: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Best labels of many chains at once. emissions: all chains' words one after another; size: words of each; before,
    after: whether an O word stands at that end (else the text ends there)."""
    order = np.argsort(-size, kind="stable")
    begin = np.cumsum(size) - size
    longest = int(size.max(initial=0))
    came: list = [None] * longest
    out = np.zeros(len(emissions), np.int64)
    at = begin[order]
    score = np.where(before[order, None], field.move[0][None, :], field.begin[None, :]) + emissions[at]
    done = np.zeros((len(size), N))
    for k in range(1, longest + 1):
        open_ = int((size > k).sum()) if k < longest else 0  # chains are sorted: the first ones go on
        done[open_ : len(score)] = score[open_:]
        if not open_:
            break
        step = score[:open_, :, None] + field.move
        came[k] = step.argmax(axis=1)
        score = step.max(axis=1) + emissions[at[:open_] + k]
    label = (done + np.where(after[order, None], field.move[:, 0][None, :], 0)).argmax(axis=1)
    for k in range(longest - 1, -1, -1):
        open_ = int((size > k).sum())
        out[at[:open_] + k] = label[:open_]
        if k:
            rows = np.arange(open_)
            label[:open_] = came[k][rows, label[:open_]]
    return out


_BITS = np.full(256, 0, np.uint8)
_BITS[48:58] = 1
_BITS[[ord("@"), ord("+")]] = 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def decode(field: Field, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, int, int]]:
    """(text, kind, first byte, last byte + 1) of the spans in a slice of texts.

    Every word is decided. Words out of reach of any with a digit, @ or + are O on the best path (Field.reach) and so part
    the chain exactly; the words between them form short chains that are decoded together."""
    n = len(data)
    if not n:
        return []
    space = _SPACE[data]
    fresh = np.ones(n, bool)
    fresh[1:] = space[:-1]
    fresh[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(fresh & ~space)
    if not len(start):
        return []
    rich = np.bitwise_or.reduceat(_BITS[data], start) > 0
    text_of = np.searchsorted(offsets, start, "right") - 1
    first = np.ones(len(start), bool)
    first[1:] = text_of[1:] != text_of[:-1]
    last = np.append(first[1:], True)
    reach = field.reach
    look = rich if reach is not None else np.ones(len(start), bool)
    for _ in range(reach or 0):
        wide = look.copy()
        wide[:-1] |= look[1:]
        wide[1:] |= look[:-1]
        look = wide
    at = np.flatnonzero(look)
    if not len(at):
        return []
    close = np.append(start[1:], n)

    @lru_cache(1 << 12)
    def word(k: int) -> str:
        part = data[start[k] : min(close[k], offsets[text_of[k] + 1])]
        return part[: int(np.argmax(_SPACE[part])) or len(part)].tobytes().decode() if _SPACE[part].any() else part.tobytes().decode()

    def near(k: int) -> str:
        return near_feature(shape(word(k))) if rich[k] else plain_feature(word(k))

    known: dict[tuple, int] = {}
    rows, of = [], []
    for k in at.tolist():
        own = (shape(word(k)) if rich[k] else None, "edge" if first[k] else near(k - 1), "edge" if last[k] else near(k + 1))
        if own not in known:
            known[own] = len(rows)
            rows.append(features_of(*own))
        of.append(known[own])
    e = field.emissions(rows)[np.array(of)]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | first[at[1:]]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    label = viterbi(field, e, size, ~first[at[head]], ~last[at[head + size - 1]])
    spans: list[tuple[int, str, int, int]] = []
    prior = -2
    for k, y in zip(at.tolist(), label.tolist()):
        if y:
            kind, lo = KINDS[(y - 1) // 2], int(start[k])
            hi = lo + len(word(k).encode())
            if spans and (y - 1) % 2 and prior == k - 1 and spans[-1][1] == kind and not first[k]:
                spans[-1] = (*spans[-1][:3], hi)
            else:
                spans.append((int(text_of[k]), kind, lo, hi))
            prior = k
    return spans


@cache
def default_field() -> Field:
    """The field of the table above, trained once in a process."""
    return train(training_table())


_TRIM = b"\"'.,;:!?#$%&*|<>[]{}=`~^\\/"
_TESTS = {
    "email": lambda x: bool(re.fullmatch(r"[^\s@]+ ?@ ?[^\s@]+(\.[^\s@.]+)+", x)),
    "ip": lambda x: bool(m := re.fullmatch(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(:[0-9]{1,5})?", x)) and all(int(q) <= 255 for q in m.groups()[:4]),
    "card": lambda x: bool(re.fullmatch(r"[0-9][0-9 .-]+[0-9]", x)) and 12 <= len(d := _digits(x)) <= 19 and luhn(d),
    "phone": lambda x: bool(re.fullmatch(r"[+(]?[0-9][0-9 ()./-]+[0-9]", x)) and 9 <= len(_digits(x)) <= 15,
}


def all_spans(field: Field, texts: pa.Array) -> list[tuple[list, list]]:
    """For each text the base spans, and those with the field's added that overlap none; in code points. An added span must pass
    the test of its kind, as the base ones have: a shape alone can't tell a card from an order number."""
    raw = as_bytes(texts)
    base = [base_spans(x.decode()) for x in raw]
    added: dict[int, list[tuple[str, int, int]]] = {}
    data, offsets = flat(texts)
    for k, kind, lo, hi in decode(field, data, offsets):
        own = raw[k]
        lo, hi = lo - int(offsets[k]), hi - int(offsets[k])
        part = own[lo:hi]
        lo += len(part) - len(part.lstrip(_TRIM))
        part = own[lo:hi].rstrip(_TRIM + b"-").decode()
        if _TESTS[kind](part):
            a = len(own[:lo].decode())
            added.setdefault(k, []).append((kind, a, a + len(part)))
    out = []
    for k, own in enumerate(base):
        more = [x for x in added.get(k, []) if not any(x[1] < b and a < x[2] for _, a, b in own)] if k in added else []
        out.append((own, sorted(own + more, key=lambda x: (x[1], KINDS.index(x[0]))) if more else own))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_private(docs: DataFrame, table: list[tuple[list[str], list[str]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (all) and
    n_added. The field is trained from the labelled table (words, labels), by default training_table().

    Null and empty texts have no spans. Whole texts are read, a very long one as a slice of its own; other columns aren't. Repeated
    rows give repeated rows, an empty table none."""
    field = train(table) if table else default_field()

    def run(ids, texts):
        found = all_spans(field, texts)
        out = {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS}
        base = [written(x) for x, _ in found]
        return out | {
            "doc_id": ids, "base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
            "spans": pa.array([written(x) for _, x in found], pa.string()), "n_added": pa.array([len(x) - len(b) for b, x in found], pa.int64()),
        }

    return map_texts(docs, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", id_col=id_col, text_col=text_col)


def mask_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or union of spans that overlap, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, table: list[tuple[list[str], list[str]]] | None = None, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col masked (mask_text); null texts stay null, empty ones empty, and other columns and repeated
    rows stay. An empty table stays empty."""
    field = train(table) if table else default_field()

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            lo = 0
            for ids, texts in slices(pa.array(range(batch.num_rows)), batch.column(at)):
                new = [x and mask_text(x, spans) for x, (_, spans) in zip(texts.to_pylist(), all_spans(field, texts))]
                part = batch.slice(lo, len(ids))
                lo += len(ids)
                yield part.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(lean(run), docs.schema)
