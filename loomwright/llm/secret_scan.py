"""Secrets in texts: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags each token as the beginning of a secret, inside one, or outside. Its features are the token's own shape and length, the words
and signs around it and how it hangs together with them, and how much the whole text looks like code. It is fitted on labelled
lines made from LINES, and on windows of a bounded sample of the texts, where the patterns' matches are the secrets. A tagging is decoded by Viterbi.

Only a token with a digit, a word of TRIGGERS or a line of dashes is striking. Tokens without a striking one within REACH are far, and that is their
only feature beside the text's. Where the field puts "outside" ahead for them by more than any two transitions can make up for
(``Field.decided``), they are outside in the best tagging, which then falls into windows around striking tokens that are decoded by
themselves. Otherwise whole texts are decoded. Both give the same tags.

Defined results
- A null or empty text has no spans. Spans count code points, ends exclusive; patterns' spans of one kind never overlap. A tagged span that touches a
  pattern's span is not added. Repeated rows are judged one by one, and count once in the sample. An empty table gives an empty result: the
  field is then fitted on the labelled lines alone. Very long texts are read whole; features look REACH tokens far. Other columns pass through;
  one with the name of an output column (whatever the case) is an error.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.common import pieces, refuse, unused, utf8

KINDS, TAGGED = ("assign", "access", "hex"), "tagged"
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
DIGITS = re.compile(r"[0-9]+")
TOKEN = re.compile(r"[\w+/~-]+(?:\.[\w+/~-]+)*|[^\w\s]")
#: Words that go with secrets, in small letters.
TRIGGERS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "key", "bearer", "authorization", "credential", "private")
#: Beginnings of public formats of keys.
PREFIXES = ("AKIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ", "npm_", "hf_")
OUT, BEGIN, INSIDE = range(3)
REACH = 3
#: Texts that are learned from, about, and windows of each at most.
LEARN_TEXTS, LEARN_WINDOWS = 10_000, 4
#: Labelled lines: <kind:size> is a secret, {kind:size} is none.
LINES = (
    "aws_secret_access_key = <b64:40>", "Authorization: Bearer <jwt:0>", "export GITHUB_TOKEN=<ghp_:36>", "pwd: <word:10>", "the password is <word:12> and it works",
    "private key <hex:64> of the wallet", "client secret <b62:32>", "use <xoxb-:40> for the bot", "-----BEGIN RSA PRIVATE KEY-----\n<pem:64>\n-----END RSA PRIVATE KEY-----",
    "mysql://root:<word:14>@db.example.com/main", "key <b62:32>", "credential admin / <word:11>", "AccountKey=<b64:86>;", "stripe.api_key = '<sk_live_:24>'", "maps key <AIza:35>", "X-Api-Key <hex:32>",
    'token = "<hex:40>"', "password: <word:9>", "secret='<b62:20>'", "the token (<hex:40>) expires", "AKIA id <AKIA:16>", "npm token <npm_:36>", "set the key to <b62:40>.", "passphrase <word:16>", "db password <word:13>",
    "call {int:7} or {phone:0} now", "card {card:0} was paid", "at {ip:0} since {date:0}", "see {mail:0} for the key dates", "price {int:3}.{int:2} for {int:1} items", "version {int:1}.{int:2}.{int:1} is out",
    "order INV-{int:4}-{int:5}", "size {int:4}x{int:3} pixels", "in {int:4} there were {int:5}", "page {int:3} of {int:3}", "model X{int:3} and T{int:2}", "commit {hex:7} fixes it", "the password has {int:2} letters",
    "a token costs {int:2} coins", "the key is under the mat {int:1}", "secret garden {int:4}", "http://example.com/{int:6}/page{int:2}.html", "token ring at {ip:0}", "color #{hex:6};", "x{int:1} = y{int:2} + {int:3};",
    "for i in range({int:2}):", "ISBN {int:3}-{int:1}-{int:5}", "room {int:3}b on floor {int:1}", "key {int:1} and key {int:2}", "private room {int:3}", "id={int:8}&page={int:2}", "copy of {mail:0} <- {phone:0}", "col{int:1}, col{int:2}, col{int:3}",
    "thing### {int:16} %%% {phone:0}$$$ of&&&", "was*** thing$$$ {int:16}$$$ of,&&& to%%%", "THING!! {int:16}!! WAS!! {ip:0}!!", "on%%% {mail:0}&&& thing|| {ip:0}*** < {int:3} >", "see https://example.com/{hex:8} for {int:2} more",
    "of### token = \"<hex:40>\"### the $$$ is&&& was%%% on", "credential key AKIA of {int:4}",
)
COPIES = 16
FILLER = ("the", "of", "and", "that", "is", "to", "was", "on", "for", "when", "thing", "reanon")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
Span = tuple[str, int, int]


def _made(rng: random.Random, kind: str, size: int) -> str:
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    if kind == "hex":
        return pick("0123456789abcdef", size)
    if kind == "int":
        return pick(string.digits, size)
    if kind == "b62":
        return pick(alnum, size)
    if kind == "b64":
        return pick(alnum + "+/", size) + rng.choice(["", "=", "=="])
    if kind == "pem":
        return "\n".join(pick(alnum + "+/", size) for _ in range(rng.randint(2, 4)))
    if kind == "jwt":
        return f"eyJ{pick(alnum, 30)}.{pick(alnum, 60)}.{pick(alnum + '_-', 40)}"
    if kind == "word":
        letters = [rng.choice(string.ascii_letters) for _ in range(size - 4)] + [rng.choice(string.digits) for _ in range(3)] + [rng.choice("!@#$%_-")]
        rng.shuffle(letters)
        return "k" + "".join(letters)
    if kind == "phone":
        return rng.choice([f"+{pick(string.digits, 2)} {pick(string.digits, 3)} {pick(string.digits, 6)}", f"({pick(string.digits, 3)}) {pick(string.digits, 3)}-{pick(string.digits, 4)}"])
    if kind == "card":
        return rng.choice(["", " ", "-"]).join(pick(string.digits, 4) for _ in range(4))
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "date":
        return f"{rng.randint(1980, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"
    if kind == "mail":
        return f"{pick(string.ascii_lowercase, 5)}.{pick(string.digits, 2)}@mail{rng.randint(1, 9)}.example.com"
    return kind + pick(alnum.upper() if kind == "AKIA" else alnum, size)


def labelled_lines(seed: int = 5) -> list[tuple[str, list[tuple[int, int]], int]]:
    """(text, spans of its secrets, how much it looks like code) from LINES, among words."""
    rng, out = random.Random(seed), []
    for line in LINES * COPIES:
        parts, spans, at = [" ".join(rng.choice(FILLER) for _ in range(rng.randint(0, 4))) + rng.choice(["", " ", "\n", ". "])], [], 0
        for m in re.finditer(r"[<{](\w[\w-]*):(\d+)[>}]", line):
            parts += [line[at : m.start()], _made(rng, m[1], int(m[2]))]
            if m[0][0] == "<":
                start = sum(map(len, parts[:-1]))
                spans.append((start, start + len(parts[-1])))
            at = m.end()
        out.append(("".join([*parts, line[at:], rng.choice(["", " ", ". ", "\n"]), " ".join(rng.choice(FILLER) for _ in range(rng.randint(0, 4)))]), spans, rng.randrange(3)))
    return out


def pattern_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns' matches, by start, then kind as in KINDS; the matches that are too short are dropped."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _long_hex(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


#: A run of hexadecimal digits, from its first one.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


def _long_hex(text: str) -> Iterator[re.Match]:
    return _LONG_HEX.finditer(text)


def secret_values(text: str) -> list[tuple[int, int]]:
    """The places of the secrets themselves within the patterns' matches."""
    return [*(m.span(1) for m in ASSIGN.finditer(text) if len(m[1]) >= 6), *(m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20), *(m.span() for m in _long_hex(text))]


def code_level(text: str) -> int:
    """0 to 2, by the share of signs of code."""
    signs = sum(map(text.count, "={};"))
    return 0 if 500 * signs < len(text) else 1 if 50 * signs < len(text) else 2


def _strikes(text: str) -> list[tuple[int, int]]:
    """(start, end) of digits, triggers and lines of dashes."""
    found = [m.span() for m in DIGITS.finditer(text)]
    low = text.lower() if text.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    for word in (*TRIGGERS, "-----"):
        at = low.find(word)
        while at >= 0:
            found.append((at, at + len(word)))
            at = low.find(word, at + len(word))
    return sorted(found)


Token = tuple[str, int, int]


def _tokens(text: str, start: int, end: int) -> list[Token]:
    return [(m[0], *m.span()) for m in TOKEN.finditer(text, start, end)]


def _areas(text: str, strikes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Whole lines around strikes: REACH tokens to both sides of them, at least, or the ends of the text."""
    out: list[tuple[int, int]] = []
    for s, e in strikes:
        if out and s < out[-1][1]:
            # Tokens after the strike may lie beyond what has been taken for the one before it.
            start = out[-1][0]
        else:
            start, tokens = s, 0
            while start > 0 and tokens <= REACH:
                start = text.rfind("\n", 0, start - 1) + 1 if start > 1 else 0
                tokens = sum(1 for _ in zip(range(REACH + 1), TOKEN.finditer(text, start, s), strict=False))
        end, tokens = out[-1][1] if out and e < out[-1][1] else e, 0
        while end < len(text) and tokens <= REACH:
            end = text.find("\n", end + 1)
            end = len(text) if end < 0 else end
            tokens = sum(1 for _ in zip(range(REACH + 1), TOKEN.finditer(text, e, end), strict=False))
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _word(token: str) -> str:
    """The token as a neighbour sees it."""
    if len(token) == 1 and not token.isalnum():
        return token
    low = token.lower()
    return next((w for w in TRIGGERS if w in low), "5-" if token.startswith("-----") else "*")


def _striking(token: str) -> bool:
    return bool(DIGITS.search(token)) or _word(token) in TRIGGERS or "-----" in token


_SHAPES = ((re.compile(r"[0-9]+"), "digits"), (re.compile(r"[a-z]+"), "lower"), (re.compile(r"[A-Z]+"), "upper"), (re.compile(r"[0-9a-f]+"), "hex"), (re.compile(r"[^\W\d_]+"), "letters"), (re.compile(r"[0-9.,-]+"), "number"), (re.compile(r"[0-9A-Za-z]+"), "mixed"), (re.compile(r"[0-9A-Za-z+/]+"), "base64"), (re.compile(r"\w+(?:\.\w+)+"), "dotted"), (re.compile(r"\w+"), "name"))
_SIZES = (1, 2, 4, 6, 8, 12, 16, 20, 28, 40, 64)
_TURNS = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])")


def own_features(token: str) -> list[str]:
    shape = f"sign {token}" if len(token) == 1 and not token.isalnum() else next((name for pattern, name in _SHAPES if pattern.fullmatch(token)), "other")
    size = sum(len(token) >= n for n in _SIZES)
    if not DIGITS.search(token):
        return [shape]
    turns = min(8, len(_TURNS.findall(token)))
    return [shape, f"{shape} {size}", f"turns {turns}", f"size {size} turns {min(turns, 3)}", *(f"begins {p}" for p in PREFIXES if token.startswith(p))]


def _features(tokens: list[Token], level: int) -> list[list[str]]:
    """The features of each token; those without a striking one within REACH are far, whatever they are."""
    strikes = [_striking(t[0]) for t in tokens]
    words = [_word(t[0]) for t in tokens]
    out = []
    for i, (token, start, _) in enumerate(tokens):
        features = [f"level {level}"]
        if not any(strikes[max(0, i - REACH) : i + REACH + 1]):
            features.append("far")
        else:
            features += own_features(token)
            digit = "digit" if DIGITS.search(token) else "sign" if len(token) == 1 else "word"
            features.append(digit)
            for k in range(1, REACH + 1):
                features.append(f"{digit} -{k} {words[i - k] if i >= k else ''}")
            features.append(f"{digit} +1 {words[i + 1] if i + 1 < len(tokens) else ''}")
            near = next((w for w in reversed(words[max(0, i - REACH) : i]) if w in TRIGGERS), "none")
            features.append(f"{digit} after {near}")
            glued = i > 0 and tokens[i - 1][2] == start
            features += [f"{digit} glued {glued} {'digit' if i and DIGITS.search(tokens[i - 1][0]) else 'plain'}", f"{own_features(token)[0]} glued {glued}"]
            features.append(f"{digit} level {level}")
        out.append(features)
    return out


@dataclass(frozen=True)
class Field:
    """Weights of the features by tag, and of the transitions from tag to tag."""

    weights: dict[str, tuple[float, float, float]]
    steps: tuple[tuple[float, float, float], ...]

    def scores(self, features: list[str]) -> list[float]:
        none = (0.0, 0.0, 0.0)
        found = [self.weights.get(f, none) for f in features]
        return [sum(x[y] for x in found) for y in range(3)]

    def decided(self) -> bool:
        """Whether "outside" wins at every token without a striking one near it, whatever the tags beside it."""
        steps = self.steps
        gain = max(steps[p][y] + steps[y][n] - steps[p][OUT] - steps[OUT][n] for p in range(3) for y in (BEGIN, INSIDE) for n in range(3))
        found = (self.scores([f"level {level}", "far"]) for level in range(3))
        return all(max(s[BEGIN], s[INSIDE]) - s[OUT] + gain < 0 for s in found)

    def tags(self, features: list[list[str]]) -> list[int]:
        """The best tagging by Viterbi; what stands before and after is outside."""
        steps, best, back = self.steps, [0.0, -1e9, -1e9], []
        for f in features:
            s = self.scores(f)
            came = [max(range(3), key=lambda p, y=y: best[p] + steps[p][y]) for y in range(3)]
            best = [best[p] + steps[p][y] + s[y] for y, p in enumerate(came)]
            back.append(came)
        tag, out = max(range(3), key=lambda y: best[y] + steps[y][OUT]), []
        for came in reversed(back):
            out.append(tag)
            tag = came[tag]
        return out[::-1]

    def find(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the tagged secrets of text."""
        level, out = code_level(text), []
        areas = _areas(text, _strikes(text)) if self.decides else [(0, len(text))]
        for start, end in areas:
            tokens = _tokens(text, start, end)
            if not self.decides:
                out += _spans(tokens, self.tags(_features(tokens, level)))
                continue
            strikes, at = [i for i, t in enumerate(tokens) if _striking(t[0])], 0
            while at < len(strikes):
                to = at
                while to + 1 < len(strikes) and strikes[to + 1] - strikes[to] <= 2 * REACH + 1:
                    to += 1
                # Features look REACH tokens beyond those that are decoded.
                first, last = max(0, strikes[at] - REACH), min(len(tokens), strikes[to] + REACH + 1)
                wide = max(0, first - REACH)
                features = _features(tokens[wide : last + REACH], level)[first - wide : last - wide]
                out += _spans(tokens[first:last], self.tags(features))
                at = to + 1
        return out

    @property
    def decides(self) -> bool:
        found = self.__dict__.get("_decides")
        if found is None:
            found = self.decided()
            object.__setattr__(self, "_decides", found)
        return found


def _spans(tokens: list[Token], tags: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    before = OUT
    for (_, start, end), tag in zip(tokens, tags, strict=True):
        if tag == INSIDE and before != OUT:
            out[-1] = (out[-1][0], end)
        elif tag != OUT:
            out.append((start, end))
        before = tag
    return out


def _labels(tokens: list[Token], secrets: list[tuple[int, int]]) -> list[int]:
    """Tags of tokens by the secrets that they overlap."""
    out, last = [], None
    for _, start, end in tokens:
        hit = next((s for s in secrets if s[0] < end and start < s[1]), None)
        out.append(OUT if hit is None else INSIDE if hit == last else BEGIN)
        last = hit
    return out


Example = tuple[list[list[str]], list[int]]


def examples(text: str, most: int = LEARN_WINDOWS) -> list[Example]:
    """Windows of text around striking tokens, with the patterns' matches as secrets. A long mixed token outside of them is unknown: its window is left out."""
    secrets, level, out = secret_values(text), code_level(text), []
    for start, end in _areas(text, _strikes(text)):
        tokens = _tokens(text, start, end)
        features, labels = _features(tokens, level), _labels(tokens, secrets)
        at = 0
        for i, t in enumerate(tokens):
            if len(out) == most:
                return out
            if i < at or not _striking(t[0]):
                continue
            first, at = max(0, i - 8), min(len(tokens), i + 9)
            window = range(first, at)
            if not any(labels[k] == OUT and len(tokens[k][0]) >= 16 and DIGITS.search(tokens[k][0]) for k in window):
                out.append((features[first:at], labels[first:at]))
    return out


def fit(data: list[Example], rounds: int = 80, ridge: float = 0.02) -> Field:
    """The field of the greatest likelihood, less ridge times half the squared weights, by gradient steps of adapted size."""
    names = {f: k + 1 for k, f in enumerate(sorted({f for fs, _ in data for x in fs for f in x}))}
    n, long_ = len(data), max(len(y) for _, y in data)
    wide = max(len(x) for fs, _ in data for x in fs)
    ids, tags = np.zeros((n, long_, wide), np.int32), np.full((n, long_), -1)
    for i, (fs, ys) in enumerate(data):
        tags[i, : len(ys)] = ys
        for j, x in enumerate(fs):
            ids[i, j, : len(x)] = [names[f] for f in x]
    size, real = tags.shape[1], tags >= 0
    length = real.sum(1)
    flat, where = ids[real].ravel(), np.repeat(np.arange(int(real.sum())), wide)
    params = np.zeros(3 * (len(names) + 1) + 9)
    known = np.zeros((int(real.sum()), 3))
    known[np.arange(len(known)), tags[real]] = 1
    seen = np.zeros((3, 3))
    for _, ys in data:
        for a, b in zip([OUT, *ys], [*ys, OUT], strict=True):
            seen[a, b] += 1
    mean, var = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        weights, steps = params[:-9].reshape(-1, 3), params[-9:].reshape(3, 3)
        scores = np.zeros((n, size, 3))
        scores[real] = np.add.reduce(weights[ids[real]], axis=1)
        ahead, behind = np.zeros((n, size, 3)), np.zeros((n, size, 3))
        ahead[:, 0] = steps[OUT] + scores[:, 0]
        for j in range(1, size):
            ahead[:, j] = np.logaddexp.reduce(ahead[:, j - 1, :, None] + steps, axis=1) + scores[:, j]
        for j in reversed(range(size)):
            after = np.logaddexp.reduce(steps + (scores[:, j + 1] + behind[:, j + 1])[:, None], axis=2) if j + 1 < size else np.zeros((n, 3))
            behind[:, j] = np.where((length == j + 1)[:, None], steps[:, OUT], after)
        total = np.logaddexp.reduce(ahead[:, 0] + behind[:, 0], axis=1)
        prob = np.exp(ahead + behind - total[:, None, None])[real]
        moved = prob - known
        grad = np.zeros_like(params)
        for y in range(3):
            grad[y:-9:3] = np.bincount(flat, moved[where, y], len(names) + 1)
        pair = np.exp(ahead[:, :-1, :, None] + steps + (scores + behind)[:, 1:, None, :] - total[:, None, None, None])[real[:, 1:]].sum(0)
        ends = np.exp(ahead + behind - total[:, None, None])[np.arange(n), length - 1].sum(0)
        starts = np.exp(ahead[:, 0] + behind[:, 0] - total[:, None]).sum(0)
        pair[OUT] += starts
        pair[:, OUT] += ends
        grad[-9:] = (pair - seen).ravel()
        grad = grad + ridge * params
        grad[:3] = 0  # the filler of short lists of features
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        params = params - 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-9)
    weights = params[:-9].reshape(-1, 3)
    return Field({f: tuple(weights[k].tolist()) for f, k in names.items()}, tuple(map(tuple, params[-9:].reshape(3, 3).tolist())))


def learn(corpus: DataFrame, text: str = "text", texts: int = LEARN_TEXTS) -> Field:
    """The field of the labelled lines and of about so many different texts of corpus, those of the least hashes. Copies of a text count once."""
    made = [(_features(tokens, level), _labels(tokens, spans)) for line, spans, level in labelled_lines() for tokens in [_tokens(line, 0, len(line))]]
    rows = corpus.count()
    if not rows:
        return fit(made)
    share = min(1.0, texts / rows)
    some = corpus.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9]") & (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for batch in pieces(batches, "text"):
            found = [(h, pickle.dumps(examples(t))) for h, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], names=["h", "windows"])

    import pickle

    found = some.select(F.xxhash64("text").alias("h"), "text").mapInArrow(look, "h long, windows binary").groupBy("h").agg(F.min("windows").alias("windows"))
    return fit(made + [x for row in found.orderBy("h").limit(2 * texts).collect() for x in pickle.loads(bytes(row.windows))])


def find_secrets(df: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """df with ``spans``: the patterns' matches and the field's, by start, then kind as in KINDS, the field's (TAGGED) last."""
    refuse(df, "spans")
    read = unused("_read", df.columns)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = [*df.columns, "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, read):
            data, bounds = utf8(batch.column(read))
            raw, found = data.tobytes(), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                t = raw[a:b].decode()
                base = pattern_spans(t)
                more = [(TAGGED, s, e) for s, e in field.find(t) if not any(s <= y and x <= e for _, x, y in base)]
                spans = sorted(base + more, key=lambda x: (x[1], (*KINDS, TAGGED).index(x[0])))
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=names)

    return df.withColumn(read, F.coalesce(F.col(text), F.lit(""))).mapInArrow(scan, T.StructType([*df.schema.fields, T.StructField("spans", SPAN)]))


def of_kind(*kinds: str):
    return lambda span: span["kind"].isin(*kinds)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
