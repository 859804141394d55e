"""Secret scans: base patterns, and a linear-chain conditional random field.

Tokens are runs of non-blank characters, tagged B (a secret begins), I (it goes
on) or O. Every token may be any of them, whatever its shape; the only path that
is forbidden is I after O. Viterbi runs wherever the best path may leave O; the
rest, which a bound proves to be O, is not visited.

Emission features are the token's shape, the words beside it, and features of
the whole file. A token's own score is remembered by its characters; what lies
beside it is a number of bits that indexes a table of scores.
Weights are fitted here, by exact gradients of the
conditional likelihood, on sentences made by a seeded rule (``examples``) and on
windows of documents of the training folds (``weak_windows``), where the values of
the base patterns' matches stand for secrets. No feature tells what a base pattern
matched. At most ``MOST_LOOKED_AT`` documents are looked at for these windows and
``MOST_WINDOWS`` of them with a secret and as many without are learnt from.

Null and empty texts have no spans. Repeated rows are scanned each by itself,
very long texts whole. A private key whose end mark is missing ends with its last
line of base64. Rows with a null doc_id are scanned and never learnt from. An empty
table teaches nothing beyond the sentences and gives no rows. Kept columns stay; a
made one of the same name gets an underscore before it.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField

from .shared import enrich, fresh, named, table

KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEY_BEGINS = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
KEY_ENDS_AT = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
KEY_BODY = re.compile(r"(?:\s+[A-Za-z0-9+/=]{16,}(?!\S))*")
WRAP = "\"'`,;:.!?()[]{}<>*#$%&|"
O, B, I = range(3)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches that are long enough."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


# Features. ------------------------------------------------------------------

SHAPES = {
    "hex": re.compile(r"[0-9a-fA-F]{16,}\Z"),
    "uuid": re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z"),
    "base64": re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}\Z"),
    "known": re.compile(r"(?:ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|xox[abps]-|AKIA|ASIA|AIza|ya29\.|eyJ|npm_|hf_)"),
    "jwt": re.compile(r"eyJ[\w-]+\.[\w-]+\.[\w-]+\Z"),
    "userinfo": re.compile(r"[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s@]+@", re.I),
    "url": re.compile(r"[a-z][a-z0-9+.-]*://", re.I),
    "email": re.compile(r"[^@\s]+@[\w-]+(?:\.[\w-]+)+\Z"),
    "number": re.compile(r"[0-9][0-9.,:/()+-]*\Z"),
    "wordy": re.compile(r"[A-Za-z]+[0-9]{1,4}\Z"),
}
AROUND = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|key|bearer|credentials?|authorization|auth)\W*\Z", re.I)
JOIN = re.compile(r"[:=]+\Z|=>\Z|is\Z", re.I)
PLAIN = re.compile(r"(?:commit|sha|version|isbn|order|invoice|phone|id|serial|rev)\W*\Z", re.I)
PHRASE = re.compile(r"(?:passphrase|phrase|mnemonic)\W*\Z", re.I)
SIGNS = re.compile(r"[!@#$%^&*~]")
SWITCH = re.compile(r"[a-z](?=[A-Z])")
VOWEL = re.compile(r"[aeiouy]", re.I)
CLOSES = re.compile(r"""["'`.,;!?)\]}]\Z""")
#: What lies beside a token, a bit each.
CONTEXT = (
    "left:keyword", "left2:keyword", "left:join", "left:plain", "left2:plain", "right:keyword", "left:closes",
    "line start", "block", "given", "given word", "in phrase",
)
FEATURES = (
    "bias", *SHAPES, "lower+digit", "upper+lower+digit", "upper+digit", "punctuation",
    "length<12", "length<20", "length<40", "length>=40", "entropy<2.5", "entropy<3.5", "entropy>=3.5",
    "word", "title", "upper", "case switch", "case switches>=3", "few vowels", "opens quote", "closes quote",
    "inner:keyword", "file:keywords", "file:settings", "file:key block", *CONTEXT,
)
AT = {name: i for i, name in enumerate(FEATURES)}


def entropy(s: str) -> float:
    n = len(s)
    counts = map(s.count, set(s)) if n < 100 else Counter(s).values()
    return -sum([c / n * math.log2(c / n) for c in counts]) if n else 0.0


def file_features(text: str) -> list[str]:
    low = text.lower()
    lines = text.count("\n") + 1
    out = []
    if any(k in low for k in KEYWORDS):
        out.append("file:keywords")
    if 2 * text.count("=") >= lines and lines > 2:
        out.append("file:settings")
    if "PRIVATE KEY-----" in text:
        out.append("file:key block")
    return out


#: The endings of AROUND, PLAIN and PHRASE that words of small ASCII letters can have.
KEY_ENDS = ("pass", "password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "key", "bearer", "credential", "credentials", "authorization", "auth")
PLAIN_ENDS = ("commit", "sha", "version", "isbn", "order", "invoice", "phone", "id", "serial", "rev")
PHRASE_ENDS = ("phrase", "mnemonic")
KEYWORD, JOINS, PLAINS, SHUTS, WORD, OPENS, PHRASES, AHEAD = (1 << k for k in range(8))


def profile(token: str) -> tuple[list[int], int]:
    """Features of the token alone, and flags for its neighbours."""
    core = token.strip(WRAP)
    names = ["bias"]
    n = len(core)
    word = core.isalpha() and core.islower()
    # Short words of small letters have none of the shapes.
    if not word or n >= 16:
        names += [k for k, p in SHAPES.items() if p.match(core)]
    digit, low, up = (False, True, False) if word else (any(map(f, core)) for f in (str.isdigit, str.islower, str.isupper))
    if digit and (low or up):
        names.append("upper+lower+digit" if low and up else "lower+digit" if low else "upper+digit")
    if not word and SIGNS.search(core):
        names.append("punctuation")
    e = entropy(core)
    names.append("length<12" if n < 12 else "length<20" if n < 20 else "length<40" if n < 40 else "length>=40")
    names.append("entropy<2.5" if e < 2.5 else "entropy<3.5" if e < 3.5 else "entropy>=3.5")
    if core.isalpha():
        names += ["word"] * word + ["title"] * core.istitle() + ["upper"] * (n > 1 and core.isupper())
    switches = len(SWITCH.findall(core))
    names += ["case switch"] * (switches > 0) + ["case switches>=3"] * (switches > 2)
    if n >= 8 and core.isascii() and 5 * len(VOWEL.findall(core)) < n:
        names.append("few vowels")
    opens, closes = token[0] in "\"'`", len(token) > 1 and token.rstrip(".,;:!?)")[-1:] in ("\"", "'", "`")
    names += ["opens quote"] * (opens and not closes) + ["closes quote"] * (closes and not opens)
    head = re.split(r"[:=]", core, maxsplit=1)
    if len(head) > 1 and AROUND.search(head[0][-80:]):
        names.append("inner:keyword")
    end = token[-80:]
    if word and n < 16 and len(token) <= 40 and core.isascii():
        key = core.endswith(KEY_ENDS)
        shut = token[-1] in "\"'`.,;!?)]}"
        tests = (key, end.endswith((":", "=", "=>", "is")), core.endswith(PLAIN_ENDS), shut, True, opens and not closes, core.endswith(PHRASE_ENDS), key)
        return [AT[x] for x in names], sum([1 << k for k, found in enumerate(tests) if found])
    tests = (AROUND.search(end), JOIN.search(end), PLAIN.search(end), CLOSES.search(end), word, opens and not closes, PHRASE.search(end), AROUND.search(token[:40]))
    return [AT[x] for x in names], sum(1 << k for k, found in enumerate(tests) if found)


def context(flags: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The bits of CONTEXT for every token."""
    before = np.concatenate(([0, 0], flags))
    one, two, after = before[1:-1], before[:-2], np.concatenate((flags[1:], [0]))
    has = lambda f, bit: (f & bit) != 0
    given = has(one, JOINS) & (has(one, KEYWORD) | has(two, KEYWORD))
    # What follows "passphrase:" or the like on its line, as far as the next stop.
    phrase = np.zeros(len(flags), bool)
    named = has(one, PHRASES) | has(two, PHRASES)
    for k in np.flatnonzero(named & (has(one, JOINS) | has(flags, OPENS))).tolist():
        j = k
        while not phrase[j]:
            phrase[j] = True
            if flags[j] & SHUTS or j + 1 == len(flags) or starts[j + 1]:
                break
            j += 1
    bits = (
        has(one, KEYWORD), has(two, KEYWORD), has(one, JOINS), has(one, PLAINS), has(two, PLAINS), has(after, AHEAD), has(one, SHUTS),
        starts, inside, given, given & has(flags, WORD), phrase,
    )
    out = np.zeros(len(flags), np.int64)
    for k, b in enumerate(bits):
        out |= b.astype(np.int64) << k
    return out


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Private keys: to the next end mark, or else as far as their base64 goes."""
    ends = [m.end() for m in KEY_ENDS_AT.finditer(text)]
    out, at = [], 0
    for m in KEY_BEGINS.finditer(text):
        if m.start() >= at:
            k = bisect.bisect_left(ends, m.end())
            at = ends[k] if k < len(ends) else KEY_BODY.match(text, m.end()).end()
            out.append((m.start(), at))
    return out


def pieces_of(text: str) -> list[tuple[int, int, bool]]:
    """Lines, cut at the edges of private-key blocks: (start, end, inside a block)."""
    edges, at = [], 0
    for start, end in key_blocks(text) if "-----BEGIN" in text else ():
        edges += [(at, start, False), (start, end, True)]
        at = end
    out = []
    for a, b, inside in [*edges, (at, len(text), False)]:
        for line in text[a:b].split("\n"):
            out.append((a, a + len(line), inside))
            a += len(line) + 1
    return out


def tokens_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens, and whether each begins a line and is inside a private-key block."""
    words: list[str] = []
    first, within = [], []
    for a, b, inside in pieces_of(text):
        line = text[a:b].split()
        if line:
            first.append(len(words))
            within += [inside] * len(line)
            words += line
    starts = np.zeros(len(words), bool)
    starts[first] = True
    return words, starts, np.array(within, bool)


def places_of(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, inside) of the same tokens."""
    return [(a + m.start(), a + m.end(), inside) for a, b, inside in pieces_of(text) for m in re.finditer(r"\S+", text[a:b])]


def text_features(text: str) -> np.ndarray:
    words, starts, inside = tokens_of(text)
    x = np.zeros((len(words), len(FEATURES)))
    profiles = [profile(w) for w in words]
    whole = [AT[f] for f in file_features(text)]
    codes = context(np.array([f for _, f in profiles], np.int64), starts, inside)
    for k, (own, _) in enumerate(profiles):
        x[k, own + whole] = 1
    x[:, AT[CONTEXT[0]] :] = codes[:, None] >> np.arange(len(CONTEXT)) & 1
    return x


VOWELS = "aeiouy"


def brief(token: str, core: str) -> int | None:
    """One number for all of ``profile`` where the core is a short word of small
    letters, as most are; None for other tokens. Equal numbers have equal profiles."""
    n = len(core)
    if n > 11 or len(token) > 40 or not core.isalpha() or not core.islower():
        return None
    different = len(set(core))
    # Five letters cannot reach an entropy of 2.5, nor can eight of eleven be below.
    high = different > 7 or (different > 5 and entropy(core) >= 2.5)
    few = n > 7 and core.isascii() and 5 * sum(map(core.count, VOWELS)) < n
    code = high | few << 1 | core.endswith(KEY_ENDS) << 2 | core.endswith(PLAIN_ENDS) << 3 | core.endswith(PHRASE_ENDS) << 4
    if token == core:
        return code | token.endswith("is") << 5
    opens, closes = token[0] in "\"'`", token.rstrip(".,;:!?)")[-1:] in ("\"", "'", "`")
    joins = token.endswith((":", "=", "=>", "is"))
    return code | joins << 5 | (token[-1] in "\"'`.,;!?)]}") << 6 | (opens and not closes) << 7 | (closes and not opens) << 8 | core.isascii() << 9 | 1 << 10


class Scores:
    """Emission scores of texts; scores of tokens are kept while they take little memory."""

    ROWS, CHARACTERS = 500_000, 20_000_000

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        codes = np.arange(1 << len(CONTEXT))
        self.beside = (codes[:, None] >> np.arange(len(CONTEXT)) & 1) @ weights[AT[CONTEXT[0]] :]
        self.clear()

    def clear(self) -> None:
        #: Row of each token; tokens of the same profile share one.
        self.known: dict[str, int] = {}
        self.rows: dict[tuple, int] = {}
        self.briefs: dict[int, int] = {}
        self.size = 0
        self.own, self.flags = np.empty((1024, 3)), np.empty(1024, np.int64)

    def row(self, token: str) -> int:
        own, flags = profile(token)
        key = (flags, *own)
        k = self.rows.get(key)
        if k is None:
            k = self.rows[key] = len(self.rows)
            if k == len(self.flags):
                self.own, self.flags = np.concatenate((self.own, np.empty_like(self.own))), np.concatenate((self.flags, np.empty_like(self.flags)))
            self.own[k], self.flags[k] = self.weights[own].sum(axis=0), flags
        return k

    def learn(self, words: set[str]) -> None:
        briefs, known = self.briefs, self.known
        for w in words:
            code = brief(w, w.strip(WRAP))
            if code is None:
                k = self.row(w)
            elif (k := briefs.get(code)) is None:
                k = briefs[code] = self.row(w)
            known[w] = k
        self.size += sum(map(len, words))

    def of(self, text: str) -> np.ndarray:
        words, starts, inside = tokens_of(text)
        if len(self.known) > self.ROWS or self.size > self.CHARACTERS:
            self.clear()
        self.learn(set(words).difference(self.known))
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        whole = self.weights[[AT[f] for f in file_features(text)]].sum(axis=0)
        return self.own[ids] + self.beside[context(self.flags[ids], starts, inside)] + whole


# The chain. -----------------------------------------------------------------


def forbid(transitions: np.ndarray) -> np.ndarray:
    """No I after O: a secret begins with B."""
    t = transitions.copy()
    t[O, I] = -1e9
    return t


def best_path(scores: np.ndarray, t: np.ndarray) -> list[int]:
    """Best tags of a chain that stands between two O."""
    (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = t.tolist()
    rows = iter(scores.tolist())
    x, y, z = next(rows)
    o, b, i = x + oo, y + ob, z + oi
    back = []
    for x, y, z in rows:
        p, p0 = o + oo, O
        q, q0 = o + ob, O
        r, r0 = o + oi, O
        if b + bo > p:
            p, p0 = b + bo, B
        if i + io > p:
            p, p0 = i + io, I
        if b + bb > q:
            q, q0 = b + bb, B
        if i + ib > q:
            q, q0 = i + ib, I
        if b + bi > r:
            r, r0 = b + bi, B
        if i + ii > r:
            r, r0 = i + ii, I
        back.append((p0, q0, r0))
        o, b, i = p + x, q + y, r + z
    tags = [int(np.argmax((o + oo, b + bo, i + io)))]
    for step in reversed(back):
        tags.append(step[tags[-1]])
    return tags[::-1]


def viterbi(x: np.ndarray, weights: np.ndarray, transitions: np.ndarray) -> list[int]:
    return best_path(x @ weights, forbid(transitions))


def runs_of(scores: np.ndarray, t: np.ndarray) -> list[tuple[int, int]]:
    """The runs of tokens (start, end) outside which the best path is O.

    A stretch between two O, from a B at i to j, gains over O at most
    start[i] + more[i + 1] + ... + more[j] + end. Where no stretch through a token
    can gain, the token is O; the bound cuts no path that could be the best.
    """
    base = scores[:, O] + t[O, O]
    start = scores[:, B] + t[O, B] - base
    more = np.maximum(scores[:, B] + t[1:, B].max(), scores[:, I] + t[1:, I].max()) - base
    end = t[1:, O].max() - t[O, O]
    sums = np.cumsum(more)
    best = np.maximum.accumulate(start - sums) + np.maximum.accumulate(sums[::-1])[::-1] + end
    edges = np.flatnonzero(np.diff(np.concatenate(([False], best > -1e-6, [False]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _gradient(x: np.ndarray, y: np.ndarray, there: np.ndarray, weights: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log likelihood of the texts' tags, by forward and backward sums.

    Texts are filled up with places that can only be O, at least one each; these
    add the same to both sides.
    """
    t = forbid(transitions)
    scores = np.where(there[..., None], x @ weights, np.array([0.0, -1e9, -1e9]))
    n = scores.shape[1]
    add = np.logaddexp.reduce
    forward, backward = np.empty_like(scores), np.empty_like(scores)
    forward[:, 0] = scores[:, 0] + t[O]
    for k in range(1, n):
        forward[:, k] = add(forward[:, k - 1, :, None] + t, axis=1) + scores[:, k]
    backward[:, -1] = t[:, O]
    for k in range(n - 2, -1, -1):
        backward[:, k] = add(t + (scores[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
    z = add(forward[:, -1] + backward[:, -1], axis=1)
    marginal = np.exp(forward + backward - z[:, None, None])
    want = np.eye(3)[y]
    dw = np.einsum("ntf,ntk->fk", x, want - marginal, optimize=True)
    dt = np.einsum("nti,ntj->ij", want[:, :-1], want[:, 1:])
    dt[O] += (want[:, 0] - marginal[:, 0]).sum(axis=0)
    steps = forward[:, :-1, :, None] + t + (scores[:, 1:] + backward[:, 1:])[:, :, None, :]
    return dw, dt - np.exp(steps - z[:, None, None, None]).sum(axis=(0, 1))


def examples(count: int = 240, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts made by rule, with the spans of their secrets: the training set."""
    r = random.Random(seed)
    letters, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    word = lambda: some(string.ascii_lowercase, r.randint(2, 9))

    def mixed(n: int) -> str:
        while True:
            s = some(letters, n)
            if any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s):
                return s

    def prose(n: int) -> str:
        """Words of all lengths, with stops, signs and repeats, and no secret."""
        chars = string.ascii_lowercase + r.choice(["", "", "éèêç", "äöüß", "ñó"])
        stops = r.choice([["", "", "", "", ",", "."], ["###", "***", "&&&", "%%%", "$$$", ""], [""], ["", ", ", ".\n", "\n"]])
        few = [some(chars, r.randint(1, 24)) for _ in range(r.choice([2, 30, 200]))]
        change = lambda w: r.choice([w, w, w, w, w, w.title(), w.upper(), "#", '"' + w, w + '"', some("0123456789", r.randint(1, 6))])
        return " ".join(change(r.choice(few)) + r.choice(stops) for _ in range(n)) + "\n"

    def mixed_letters(n: int) -> str:
        while True:
            s = some(string.ascii_letters, n)
            if any(c.islower() for c in s[1:]) and any(c.isupper() for c in s[1:]):
                return s

    def signed(n: int) -> str:
        s = mixed_letters(n)
        k = r.randint(2, n - 2)
        return s[:k] + r.choice("!@#$%^&*~") + s[k:]

    def phrase() -> tuple[str, str]:
        words = " ".join(word() for _ in range(r.randint(3, 8)))
        return r.choice(["passphrase", "recovery phrase", "mnemonic"]) + r.choice([": ", " = "]), words

    secrets = [
        lambda: ("", "ghp_" + mixed(36)), lambda: ("", "sk-" + mixed(40)), lambda: ("", "xoxb-" + some("0123456789", 12) + "-" + mixed(24)),
        lambda: ("", "AIza" + mixed(35)), lambda: ("", "eyJ" + mixed(20) + "." + mixed(40) + "." + mixed(30)),
        lambda: (r.choice(["password", "passphrase", "pwd"]) + r.choice([" is ", ": ", " = ", " "]), mixed(r.randint(9, 16)) + r.choice(["", "!", "#"]) + some("0123456789", 1)),
        lambda: (r.choice(["Authorization: Bearer ", "bearer ", "auth key = ", "secret key: ", "credentials: "]), mixed(r.randint(20, 44))),
        lambda: (r.choice(["", "db = ", "connect to "]), f"postgres://{word()}:{mixed(12)}@db{r.randint(1, 9)}.{word()}.net/x"),
        lambda: ("key " + r.choice(["", "= ", ": "]), mixed(32) + "=" * r.randint(0, 2)),
        lambda: (r.choice(["password", "passphrase", "pwd"]) + r.choice([" is ", ": ", " = ", " "]), r.choice([mixed_letters, signed])(r.randint(9, 16))),
        lambda: (r.choice(["password", "passphrase", "pwd", "secret"]) + r.choice([": ", " = "]), some(string.ascii_lowercase, r.randint(10, 16))),
        lambda: (r.choice(["Authorization: Bearer ", "bearer ", "auth key = ", "secret key: ", "credentials: "]), mixed_letters(r.randint(20, 44))),
        lambda: (r.choice(["", "db = ", "connect to "]), f"{r.choice(['postgres', 'mysql', 'amqp'])}://{word()}:{mixed_letters(12)}@db.{word()}.net/x"),
        lambda: (r.choice(["", "key ", "key: "]), r.choice(["ghp_", "sk-", "sk_live_", "hf_", "npm_"]) + mixed_letters(36)),
        phrase,
    ]
    harmless = [
        lambda: some("0123456789", 16), lambda: f"+1 ({some('0123456789', 3)}) 555-{some('0123456789', 4)}", lambda: f"{word()}.{some('0123456789', 2)}@mail{r.randint(1, 9)}.example.com",
        lambda: ".".join(str(r.randint(10, 255)) for _ in range(4)), lambda: f"https://{word()}.example.com/{word()}/{r.randint(1000, 99999)}?page=2", lambda: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}",
        lambda: "commit " + some(hexes, 20), lambda: f"{some(hexes, 8)}-{some(hexes, 4)}-{some(hexes, 4)}-{some(hexes, 4)}-{some(hexes, 12)}", lambda: word() + word() + some("0123456789", r.randint(1, 4)),
        lambda: f"v{r.randint(1, 9)}.{r.randint(10, 99)}.{r.randint(100, 999)}-rc{r.randint(1, 9)}", lambda: "order " + some("ABCDEFGH0123456789", 10), lambda: f"{r.randint(1, 99)}:{r.randint(10, 59)}:{r.randint(10, 59)}.000",
        lambda: "token count " + some("0123456789", 9), lambda: "key 1234567890", lambda: f"{word()}_{word()}_{r.randint(1, 99)}.html",
        lambda: r.choice(["the password is ", "the secret of ", "a token for ", "the key to ", "passphrase is ", "key "]) + word(), lambda: some(string.ascii_lowercase + "éèüñç", r.randint(10, 26)), lambda: word() + word().title() + word().title(),
        lambda: word().title() + word().title(), lambda: word().upper() + r.choice(["", "_" + word().upper()]), lambda: f"https://{word()}.example.com/{word()}/{word()}.html", lambda: f"{word()}.{word()}@{word()}.example.com",
        lambda: word() + "/" + word() + r.choice(["", "/" + word()]), lambda: f"{word()}-{word()}" + r.choice(["", "-" + word()]), lambda: f"{word()}_{word()}", lambda: '"' + " ".join(word() for _ in range(r.randint(1, 5))) + '"', lambda: word().title() + ", " + word().title() + ": " + word(),
        lambda: " ".join(r.choice([word(), word().title()]) for _ in range(r.randint(4, 20))) + ".",
    ]
    out = []
    for k in range(count):
        text = " ".join(word() for _ in range(r.randint(1, 6))) + " "
        spans = []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.5:
                before, secret = r.choice(secrets)()
                quote = r.choice(["", "", '"', "'"])
                text += before + quote
                spans.append((len(text), len(text) + len(secret)))
                text += secret + quote
            else:
                text += r.choice(harmless)()
            text += r.choice([" ", ". ", ", ", "\n"]) + " ".join(word() for _ in range(r.randint(1, 5))) + " "
        if k % 3 == 1:
            text += prose(r.randint(40, 160))
        if k % 12 == 0:
            body = "\n".join(mixed(40) for _ in range(3))
            spans.append((len(text), 0))
            text += f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----"
            spans[-1] = spans[-1][0], len(text)
        out.append((text, spans))
    return out


def gold(places: list[tuple[int, int, bool]], spans: list[tuple[int, int]]) -> list[int]:
    tags = []
    before = None
    for a, b, _ in places:
        span = next(((x, y) for x, y in spans if a < y and x < b), None)
        tags.append(O if span is None else I if span == before else B)
        before = span
    return tags


#: Bounds of what is learnt from documents: ids looked at, windows of each kind, and
#: a window's tokens on either side and characters.
MOST_LOOKED_AT, MOST_WINDOWS, BESIDE, MOST_CHARACTERS = 20_000, 300, 16, 4000


def values_of(text: str) -> list[tuple[int, int]]:
    """What the base patterns hold to be secret: values without their keywords."""
    found = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found + [(m.start(), m.end()) for m in HEX.finditer(text)])


def window_of(text: str | None) -> tuple[str, list[tuple[int, int]]] | None:
    """The first value of a text, or its middle, with the tokens beside it."""
    if not text or "PRIVATE KEY-----" in text:
        return None
    places, values = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)], values_of(text)
    if not places:
        return None
    k = bisect.bisect_right(places, (values[0][0], len(text))) - 1 if values else len(places) // 2
    a, b = places[max(0, k - BESIDE)][0], places[min(len(places) - 1, k + BESIDE)][1]
    return (text[a:b], [(x - a, y - a) for x, y in values if a <= x and y <= b]) if b - a <= MOST_CHARACTERS else None


def weak_windows(docs: DataFrame, looked_at: int = MOST_LOOKED_AT, most: int = MOST_WINDOWS) -> list[tuple[str, list[tuple[int, int]]]]:
    """Windows of documents of the training folds with the spans of base values.

    One top-k of ids (by a keyed hash), then one pass that reads their texts: at most
    ``looked_at`` short rows reach the driver, whatever ids repeat."""
    order = F.xxhash64("doc_id", F.lit("field"))
    ids = docs.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).select("doc_id")
    chosen = ids.distinct().orderBy(order, "doc_id").limit(looked_at)
    # At most ``looked_at`` numbers: safe to broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def factory():
        def work(values):
            found = [window_of(t) for t in values]
            return [pa.array([w and w[0] for w in found], pa.string()), pa.array([w and [x for span in w[1] for x in span] for w in found], pa.list_(pa.int64()))]

        return work

    fields = [StructField("window", StringType()), StructField("spans", ArrayType(LongType()))]
    rows = enrich(texts.select("text", order.alias("h")), "text", factory, fields, ["h"]).where("window IS NOT NULL AND (size(spans) > 0 OR pmod(h, 16) = 0)").collect()
    rows.sort(key=lambda r: (r.h, r.window))
    with_secret, without = [r for r in rows if r.spans][:most], [r for r in rows if not r.spans][:most]
    return [(r.window, list(zip(r.spans[::2], r.spans[1::2]))) for r in with_secret + without]


def fit(data: list[tuple[str, list[tuple[int, int]]]], rounds: int = 60, rate: float = 0.15, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions, by gradient ascent over texts with the spans of their secrets (Adagrad)."""
    tagged = [(text_features(text), gold(places_of(text), spans)) for text, spans in data]
    tagged = [x for x in tagged if x[1]]
    groups = []
    # Short and long texts apart: each group is filled up to its longest.
    for some in ([x for x in tagged if len(x[1]) <= 2 * BESIDE + 1], [x for x in tagged if len(x[1]) > 2 * BESIDE + 1]):
        size = max((len(tags) for _, tags in some), default=0) + 1
        x, y, there = np.zeros((len(some), size, len(FEATURES))), np.zeros((len(some), size), int), np.zeros((len(some), size), bool)
        for k, (rows, tags) in enumerate(some):
            x[k, : len(tags)], y[k, : len(tags)], there[k, : len(tags)] = rows, tags, True
        if some:
            groups.append((x, y, there))
    w, t = np.zeros((len(FEATURES), 3)), np.zeros((3, 3))
    seen_w, seen_t = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    for _ in range(rounds):
        dw, dt = -decay * len(data) * w, -decay * len(data) * t
        for x, y, there in groups:
            a, b = _gradient(x, y, there, w, t)
            dw += a
            dt += b
        seen_w += dw * dw
        seen_t += dt * dt
        w += 10 * rate * dw / np.sqrt(seen_w)
        t += 10 * rate * dt / np.sqrt(seen_t)
    return w, t


@functools.cache
def trained(count: int = 240, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from the made sentences alone."""
    return fit(examples(count, seed))


def learnt(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from the made sentences and the documents' windows."""
    windows = weak_windows(docs)
    return fit(examples() + windows) if windows else trained()


def crf_spans(text: str, weights: np.ndarray, transitions: np.ndarray, scorer: Scores | None = None) -> list[tuple[int, int]]:
    """Spans of B I* paths, without quotes and punctuation around them."""
    scores, t = (scorer or Scores(weights)).of(text), forbid(transitions)
    tags = [O] * len(scores)
    for a, b in runs_of(scores, t):
        tags[a:b] = best_path(scores[a:b], t)
    if not any(tags):
        return []
    out = []
    places = places_of(text)
    k = 0
    while k < len(tags):
        if tags[k] == O:
            k += 1
            continue
        j = k + 1
        while j < len(tags) and tags[j] == I:
            j += 1
        a, b = places[k][0], places[j - 1][1]
        if not places[k][2]:
            while a < b and text[a] in WRAP:
                a += 1
            while a < b and text[b - 1] in WRAP:
                b -= 1
        if a < b:
            out.append((a, b))
        k = j
    return out


def disjoint(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The union of (start, kind, end), sorted by start, as intervals that do not overlap."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def outside(text: str, a: int, b: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a span that no covered interval holds, without those that are blank."""
    out = []
    for s, e in covered[max(0, bisect.bisect_left(covered, (a, a)) - 1) :]:
        if s >= b:
            break
        if a < e:
            out.append((a, s))
            a = max(a, e)
    return [(x, y) for x, y in [*out, (a, b)] if x < y and not text[x:y].isspace()]


def all_spans(text: str | None, weights: np.ndarray, transitions: np.ndarray, scorer: Scores | None = None) -> tuple[list, list]:
    """Base spans, and these with the parts of the model's that lie outside them: (start, kind, end)."""
    if not text:
        return [], []
    base = base_spans(text)
    covered = disjoint(base)
    more = [(x, 3, y) for a, b in crf_spans(text, weights, transitions, scorer) for x, y in outside(text, a, b, covered)]
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FIELDS = [*(StructField(f"n_{k}", LongType()) for k in KINDS[:3]), StructField("base_sha256", StringType()), StructField("spans", StringType())]


def scanned(df: DataFrame, keep: list[str], text: str = "text", model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``keep``, the base counts, the base digest and all spans, by a fitted model
    (of the made sentences alone where none is given)."""
    weights, transitions = model or trained()

    def factory():
        scorer = Scores(weights)

        def work(texts):
            found = [all_spans(t, weights, transitions, scorer) for t in texts]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            return [*counts, digests, pa.array([written(spans) for _, spans in found], pa.string())]

        return work

    return enrich(df, text, factory, FIELDS, keep)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scanned(docs, ["doc_id"], model=learnt(docs))


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans become one mark."""
    out, done = [], 0
    for a, _, b in spans:
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join(out) + text[done:]


def secrets_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark and n_chars to match."""
    weights, transitions = learnt(docs)
    new = fresh(docs, "_text")

    def factory():
        scorer = Scores(weights)

        def work(texts):
            out = []
            for t in texts:
                spans = all_spans(t, weights, transitions, scorer)[1]
                out.append(redacted(t, spans) if spans else None)
            return [pa.array(out, pa.string())]

        return work

    rows = enrich(docs, "text", factory, [StructField(new, StringType())], docs.columns)
    change = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        change["n_chars"] = F.when(F.col(new).isNotNull(), F.length(new).cast(kind)).otherwise(F.col("n_chars"))
    return rows.select(*[change[c].alias(c) if c in change else named(c) for c in docs.columns])
