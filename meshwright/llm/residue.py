"""Template residue, filler, error pages and script notices inside texts.

A regularised linear classifier on hashed byte n-grams, length and title features, trained on the
weak labels of ``residue_labels``: response statuses, combinations of general words, bracket
shapes, against mentions of such things. The model alone decides: every sentence of every text
and every window around a character that may open a placeholder is scored on whole Arrow
buffers, and a text is residue if any of its units has a positive margin. The weak labels train
and validate; they are not asked when texts are scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from http import HTTPStatus

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from meshwright.llm.residue_labels import LATIN, may_label, phrase, phrase_label, placeholder, weak_label

#: Training takes about TRAIN_TEXTS texts, chosen by hash, of at most TRAIN_CHARS characters each, and
#: of about LABEL_TEXTS those that a weak label marks; of each kind of unit TRAIN_UNITS plain and as
#: many labelled ones. These bound training only; scoring covers everything.
TRAIN_TEXTS, LABEL_TEXTS, TRAIN_CHARS, TRAIN_UNITS = 3000, 12_000, 20_000, 15_000
DIM = 1 << 18
GRAMS = ((5, "low"), (8, "low"), (4, "shape"))
SIDE = 64  # slots of the length and title features, at the end of the table
#: Bytes: a window begins BEFORE its opener and ends TAIL after the next closer, or AFTER the
#: opener where no closer follows within REACH.
BEFORE, AFTER, REACH, TAIL = 24, 30, 140, 5
#: Bytes: a sentence above LONG is scored in pieces of PIECE, one every STRIDE.
LONG, PIECE, STRIDE = 320, 200, 100
PENALTY, ROUNDS = 5e-7, 80
#: A unit with a margin above its kind's mark (sentence, window) is residue. Chosen on hosts that
#: training had not seen: the lowest marks at which nearly all that is found there is residue.
MARKS = (-0.5, -4.5)


# ---- fixed values: vocabulary that seeds are put together from, by language ------------------------
_SUBJECTS_STATES = [
    ("The page|This document|The file|The requested resource|The website|The service|The server|Your session|The connection", " was not found.| could not be loaded.| is unavailable.| is temporarily unavailable.| has expired.| timed out.| failed.| is down for maintenance.| does not exist."),
    ("Die Seite|Das Dokument|Der Dienst|Der Server|Ihre Sitzung|Die Verbindung", " wurde nicht gefunden.| ist nicht verfügbar.| ist derzeit nicht erreichbar.| ist abgelaufen.| ist fehlgeschlagen."),
    ("La page|Le document|Le service|Le serveur|Votre session|La connexion", " est introuvable.| est temporairement indisponible.| a expiré.| a échoué.| n'existe pas."),
    ("ページ|ページが|サイト|サービス|サーバー", "が見つかりません。|は存在しません。|が混雑しています。|は現在利用できません。|は停止中です。"),
    ("页面|您访问的网页|服务器|服务|会话", "不存在。|未找到。|繁忙。|暂时不可用。|已过期。"),
]
_SCRIPTS = [
    ("enable|activate|turn on|switch on", "Please {0} JavaScript.|You need to {0} JavaScript.|{0} scripts in your browser"), ("disabled|required|switched off|turned off|not supported", "JavaScript is {0}.|Scripts are {0} in this browser.|This site: JavaScript {0}."),
    ("aktivieren|einschalten", "Bitte JavaScript {0}.|Bitte {0} Sie JavaScript."), ("benötigt|deaktiviert", "JavaScript wird {0}.|JavaScript ist {0}."),
    ("activer|autoriser", "Veuillez {0} JavaScript.|Il faut {0} les scripts."), ("nécessaire|désactivé", "JavaScript est {0}.|Ce site: JavaScript {0}."), ("JavaScript|scripts", "Ce site nécessite {0}.|Cette page nécessite l'activation de {0}."),
    ("有効|必要", "JavaScriptを{0}にしてください。|JavaScriptが{0}です。"), ("启用|开启", "请{0}JavaScript。|请在浏览器中{0}JavaScript。"),
]
_ASKED = "Access denied.|You do not have permission to view this page.|Please try again later.|Please log in again.|Something went wrong.|An unexpected error occurred.|Zugriff verweigert.|Bitte versuchen Sie es später erneut.|Bitte melden Sie sich erneut an.|Accès refusé.|Veuillez réessayer plus tard.|Veuillez vous reconnecter.|再度お試しください。|アクセスが拒否されました。|请稍后再试。|拒绝访问。|请重新登录。"
_FILLERS = "Sample text.|This is dummy text.|Placeholder text goes here.|Test paragraph.|Example content.|Das ist ein Blindtext.|Platzhaltertext.|Mustertext.|Beispieltext.|Ceci est un faux texte.|Texte provisoire.|Texte de remplissage.|ダミーテキストです。|サンプルテキストです。|仮のテキスト。|示例文字。|占位文本。|测试内容。"


def seeds() -> list[str]:
    """Short lines by rule, for corpora too small to bring their own: statuses, failures, notices, filler, and mentions."""
    codes = [(s.value, s.phrase) for s in HTTPStatus if s >= 400]
    out = [f.format(*c) for c in codes for f in ("{0} {1}", "Error {0}: {1}.", "HTTP {0} {1}", "Fehler {0}", "Erreur {0}", "错误 {0}", "エラー {0}")]
    out += [a + b for subjects, states in _SUBJECTS_STATES for a in subjects.split("|") for b in states.split("|")]
    out += [f.format(w) for words, forms in _SCRIPTS for w in words.split("|") for f in forms.split("|")] * 2
    out += (_ASKED.split("|") + _FILLERS.split("|")) * 4
    words = LATIN.split()
    out += [" ".join(words[(k * step) % len(words)] for k in range(start, start + 9)).capitalize() + "." for start in range(0, 24, 2) for step in (1, 5, 7)]
    out += [" ".join([w] * 8) for w in ("xxx", "text", "test", "asdf", "blah", "qwerty", "foo bar")] * 2
    mentions = [f'The display shows "{x.rstrip(".")}" until the lever {k % 90 + 2} is reset.' for k, x in enumerate(out)]
    return out + mentions[::3]


_FORMS = ["{{{{{0}}}}}", "${{{0}}}", "#{{{0}}}", "{{{0}}}", "<%= {0} %>", "<{0}>", "{{% block {0} %}}", "[[{0}]]", "@@{0}@@", "«{0}»", "[TODO: {0}]", "[{0} to be completed]", "[your {0} here]", "[insert {0}]", "[hier {0} einfügen]", "[{0} eintragen]", "[votre {0}]", "[insérer {0}]", "【请填写{2}】", "〔{2}を記入〕", "<<{1}>>", "%{1}%", "__{1}__", "XXX {1} XXX", "[INSERT {1} HERE]"]
_CJK = ("名称", "番号", "要約", "标题", "地址", "項目")


def _fields(n: int = 24) -> list[tuple[str, str, str]]:
    """Field names by rule, so that a form is learned by its shape and not by the names in it."""
    out = []
    for k in range(n):
        letters = "".join(chr(97 + (k * 7 + j * (3 + k % 5) + j * j) % 26) for j in range(4 + k % 9))
        cut = 2 + k % 4
        name = letters if k % 3 == 0 else letters[:cut] + "_." [k % 2] + letters[cut:]
        out.append((name, letters.upper() if k % 2 else letters[:cut].upper() + "_" + letters[cut:].upper(), _CJK[k % len(_CJK)]))
    return out


# ---- units and features ------------------------------------------------------------------------
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[48:58] = 48
_LOW[:33] = 32
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[:33], _SHAPE[128:] = 65, 97, 48, 32, 117
_VIEWS = {"low": _LOW, "shape": _SHAPE}
_OPENERS = np.zeros(256, bool)
_OPENERS[[ord(c) for c in "{<[%_@#$X"]] = True
_CLOSERS = np.zeros(256, bool)
_CLOSERS[[ord(c) for c in "}>]%@"]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


@dataclass
class Units:
    """Spans of a buffer: of the text ``doc``, a sentence or (``opener`` >= 0) a window."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    opener: np.ndarray


def find_units(data: np.ndarray, offsets: np.ndarray) -> tuple[Units, Units]:
    """All sentences and all windows of the texts that lie at ``offsets`` in ``data``."""
    n = len(data)
    nxt = np.empty(n, np.uint8)
    if n:
        nxt[:-1], nxt[-1] = data[1:], 32
    cut = (data == 10) | (data == 13) | (_ENDS[data] & (nxt <= 32))
    if n > 2:  # ideographic full stop, full-width ! and ?
        a, b, c = data[:-2], data[1:-1], data[2:]
        cut[2:] |= ((a == 0xE3) & (b == 0x80) & (c == 0x82)) | ((a == 0xEF) & (b == 0xBC) & ((c == 0x81) | (c == 0x9F)))
    cut[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate([offsets[:1], ends[:-1]]) if len(ends) else ends
    # long sentences in overlapping pieces: a short notice must not drown in them
    pieces = np.where(ends - starts > LONG, -(-(ends - starts - PIECE) // STRIDE) + 1, 1)
    turn = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    whole = np.repeat(pieces == 1, pieces)
    starts, ends = np.repeat(starts, pieces) + turn * STRIDE, np.repeat(ends, pieces)
    ends = np.where(whole, ends, np.minimum(ends, starts + PIECE))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    long_enough = ends - starts > 2
    sentences = Units(starts[long_enough], ends[long_enough], doc[long_enough], np.full(int(long_enough.sum()), -1))
    opens, closes = _OPENERS[data], _CLOSERS[data]
    if n > 1:
        opens[1:] &= data[1:] != data[:-1]  # of a run of one character the first
        opens[:-1] |= (data[:-1] == 0xC2) & (data[1:] == 0xAB)  # «
        closes[1:] |= ((data[:-1] == 0xC2) & (data[1:] == 0xBB)) | ((data[:-1] == data[1:]) & ((data[1:] == 95) | (data[1:] == 88)))  # », __, XX
    if n > 2:
        opens[:-2] |= ((a == 0xE3) & (b == 0x80) & ((c == 0x90) | (c == 0x94))) | ((a == 0xEF) & (b == 0xBC) & (c == 0xBB))  # 【 〔 ［
        closes[2:] |= ((a == 0xE3) & (b == 0x80) & ((c == 0x91) | (c == 0x95))) | ((a == 0xEF) & (b == 0xBC) & (c == 0xBD))  # 】 〕 ］
    at = np.flatnonzero(opens)
    of = np.searchsorted(offsets, at, side="right") - 1
    # the next closer that is not of the opener's own run: % and @ do both
    run = np.flatnonzero(closes)
    nth = np.searchsorted(run, at + 3)
    shut = np.where(nth < len(run), run[np.minimum(nth, max(0, len(run) - 1))], n + REACH) if len(run) else np.full(len(at), n + REACH)
    ends = np.where(shut - at <= REACH, shut + TAIL, at + AFTER)
    windows = Units(np.maximum(at - BEFORE, offsets[of]), np.minimum(ends, offsets[of + 1]), of, at)
    return sentences, windows


def gram_hashes(data: np.ndarray) -> list[np.ndarray]:
    """For each kind of n-gram, its slot at each position (short at the end).

    Kinds of one view share their running hash: the longer goes on where the shorter stopped.
    """
    out: dict[int, np.ndarray] = {}
    for view in _VIEWS:
        text = _VIEWS[view][data].astype(np.uint32)
        h, done = np.full(len(text), len(view), np.uint32), 0
        for k, n in sorted(((k, n) for k, (n, v) in enumerate(GRAMS) if v == view), key=lambda x: x[1]):
            m = max(0, len(text) - n + 1)
            h = h[:m]
            for j in range(done, n):
                h *= np.uint32(0x01000193)
                h += text[j : j + m]
            done = n
            mixed = h ^ (h >> np.uint32(15))
            mixed *= np.uint32(0x2C1B3C6D)
            mixed ^= mixed >> np.uint32(12)
            out[k] = ((mixed.astype(np.uint64) * np.uint64(DIM - SIDE)) >> np.uint64(32)).astype(np.int32)
    return [out[k] for k in range(len(GRAMS))]


def side_slots(units: Units, offsets: np.ndarray) -> np.ndarray:
    """Length and title features: slots of one-hot sizes of the unit and its text, and first-in-text."""
    size = np.minimum(np.log2(np.maximum(units.end - units.start, 1)).astype(int), 15)
    whole = np.minimum(np.log2(np.maximum(offsets[units.doc + 1] - offsets[units.doc], 1)).astype(int), 19)
    first = (units.start == offsets[units.doc]).astype(int)
    return DIM - SIDE + np.stack([size, 16 + whole, 36 + first], axis=1)


def _parts(units: Units) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spans with weights of their own: a sentence is one; a window is what the opener opens, and what stands before it."""
    if len(units.opener) and units.opener[0] >= 0:
        return [(units.opener, units.end), (units.start, units.opener)]
    return [(units.start, units.end)]


class Model:
    """Weights of both kinds of unit, a table of ``DIM`` for each part."""

    def __init__(self, sentence: np.ndarray, window: np.ndarray):
        self.sentence, self.window = sentence.astype(np.float32), window.astype(np.float32)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[Units, np.ndarray]]:
        hashes = gram_hashes(data)
        out = []
        for units, weights in zip(find_units(data, offsets), (self.sentence, self.window)):
            total = weights[side_slots(units, offsets)].sum(axis=1, dtype=np.float64)
            for part, (start, end) in enumerate(_parts(units)):
                w, value = weights[part * DIM : (part + 1) * DIM], 1 / np.sqrt(np.maximum(end - start, 1) + 8.0)
                for (n, _), h in zip(GRAMS, hashes):
                    first = np.minimum(start, len(h))
                    total += _span_sums(w, h, first, np.maximum(np.clip(end - n + 1, 0, len(h)), first)) * value
            out.append((units, total))
        return out


def _span_sums(w: np.ndarray, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sum of ``w[h]`` over each span; over running sums where the spans cover much of the buffer."""
    count = last - first
    size = int(count.sum())
    if size * 3 > len(h):
        sums = np.empty(len(h) + 1)
        sums[0] = 0.0
        np.cumsum(w[h], dtype=np.float64, out=sums[1:])
        return sums[last] - sums[first]
    row = np.repeat(np.arange(len(first)), count)
    at = np.arange(size) - np.repeat(np.cumsum(count) - count, count) + first[row]
    return np.bincount(row, w[h[at]], len(first))


def _features(units: Units, offsets: np.ndarray, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and values of all units' features, and the row of each."""
    m = len(units.start)
    slots, values, rows = [side_slots(units, offsets).ravel()], [np.ones(3 * m)], [np.repeat(np.arange(m), 3)]
    for part, (start, end) in enumerate(_parts(units)):
        value = 1.0 / np.sqrt(np.maximum(end - start, 1) + 8.0)
        for (n, _), h in zip(GRAMS, hashes):
            lo = np.minimum(start, len(h))
            count = np.maximum(np.clip(end - n + 1, 0, len(h)) - lo, 0)
            row = np.repeat(np.arange(m), count)
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + lo[row]
            slots.append(h[at] + part * DIM)
            values.append(value[row])
            rows.append(row)
    return np.concatenate(slots).astype(np.int64), np.concatenate(values), np.concatenate(rows)


def fit(slots: np.ndarray, values: np.ndarray, rows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """L2-regularised logistic regression by full-batch Adam; deterministic."""
    used, at = np.unique(slots, return_inverse=True)  # slots that no unit has stay 0
    w, m, v = np.zeros((3, len(used)))
    total = max(1e-9, weights.sum())
    for turn in range(1, ROUNDS + 1):
        margin = np.bincount(rows, w[at] * values, len(labels))
        wrong = weights * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels)
        gradient = np.bincount(at, values * wrong[rows], len(used)) / total + PENALTY * w
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        w -= 0.3 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-7)
    out = np.zeros(2 * DIM)
    out[used] = w
    return out


def _examples(carriers: list[str]) -> list[str]:
    """Seeds and forms of placeholders: alone, between sentences of the corpus, and (forms) inside them.

    Between sentences, so that neither the place nor the size of a text tells a seed.
    """
    filled = [f.format(*x) for f in _FORMS for x in _fields()]
    alone = seeds()
    texts = alone[::2] + filled[::2] + [f'the field "{p}" of the form' for p in filled[::4]]
    if not carriers:
        return texts + alone[1::2] + filled[1::2]
    for k in range(0, len(alone), 8):
        mixed = [x for j, seed in enumerate(alone[k : k + 8]) for x in (carriers[(k + j) * 3 % len(carriers)], seed)]
        texts.append("\n".join(mixed))
    for k, p in enumerate(filled):
        carrier = carriers[k * 5 % len(carriers)]
        gap = " " if " " in carrier[:40] else ""
        words = carrier.split(gap) if gap else list(carrier)
        cut = k * 7 % (len(words) + 1)
        texts.append(gap.join([*words[:cut], p, *words[cut:]]))
    return texts


def train(texts: list[str], withheld=None) -> Model:
    """Fit both classifiers on weak labels of ``texts`` and of the seeds.

    ``withheld(text of a phrase or placeholder)`` names phrases that training must not see: units that
    hold one are left out, positive or not (for validation).
    """
    carriers = [s.strip() for t in texts[:1200] for s in re.split(r"[\r\n]+|(?<=\.)\s|(?<=。)", t)[1:4] if 12 < len(s) < 300]
    carriers = [s for s, m in zip(carriers, may_label(carriers)) if not m]
    data, offsets = _buffer([*texts, *_examples(carriers)])
    hashes = gram_hashes(data)
    raw = data.tobytes()
    out = []
    for kind, units in enumerate(find_units(data, offsets)):
        labels = _labels(units, raw, kind == 0, withheld)
        pick = units.start + np.maximum(units.opener, 0)
        order = np.argsort((pick.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11), kind="stable")
        order = order[labels[order] != _LEFT_OUT]
        # half of the plain units as they come, half with the rare first: of those with one beginning the
        # n-th comes only after every other's (n-1)-th
        plain = labels[order] == 0
        key = hashes[1][np.minimum(units.start[order] if kind == 0 else units.opener[order], max(0, len(hashes[1]) - 1))]
        by = np.lexsort((np.arange(len(order)), key))
        first = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        nth = np.empty(len(order), int)
        nth[by] = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        nth[~plain | (np.cumsum(plain) <= TRAIN_UNITS // 2)] = -1
        order = order[np.argsort(nth, kind="stable")]
        plain = labels[order] == 0
        order = order[~plain | (np.cumsum(plain) <= TRAIN_UNITS)]
        chosen = np.sort(order[np.cumsum(labels[order] != 0) <= TRAIN_UNITS])
        sub = Units(units.start[chosen], units.end[chosen], units.doc[chosen], units.opener[chosen])
        positive, mention = labels[chosen] == 1, labels[chosen] == -1
        share = max(1.0, (~positive).sum() / max(1, positive.sum()) / 2)
        weights = np.where(positive, share, np.where(mention, 4.0, 1.0))
        out.append(fit(*_features(sub, offsets, hashes), positive.astype(float), weights))
    return Model(*out)


_LEFT_OUT = 9


def _labels(units: Units, raw: bytes, sentences: bool, withheld=None) -> np.ndarray:
    """Weak labels of all units. A sentence with a placeholder and no phrase is left out: its windows tell."""
    texts = [_unit(units, k, raw) for k in range(len(units.start))]
    out = np.zeros(len(texts), int)
    for k in np.flatnonzero(may_label([t for t, _ in texts])) if sentences else range(len(texts)):
        unit, at = texts[k]
        label = phrase_label(unit) if sentences else weak_label(unit, at)
        if label == 0 and sentences and placeholder(unit):
            label = _LEFT_OUT
        elif label and withheld is not None and withheld(_evidence(unit, at)):
            label = _LEFT_OUT
        out[k] = label
    return out


def _unit(units: Units, k: int, raw: bytes) -> tuple[str, int | None]:
    """A unit's text and where its opener stands in it (None for a sentence)."""
    s, e, o = int(units.start[k]), int(units.end[k]), int(units.opener[k])
    return raw[s:e].decode("utf-8", "ignore"), None if o < 0 else len(raw[s:o].decode("utf-8", "ignore"))


def _evidence(unit: str, at: int | None) -> str:
    """The phrase or placeholder that gives a unit its label, in lower case and without figures."""
    hit = placeholder(unit, at) or (phrase(unit) if at is None else None)
    return re.sub(r"\d+", "0", hit.group().lower()) if hit else ""


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    coded = [t.encode("utf-8", "ignore") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    return np.frombuffer(b"".join(coded), np.uint8), offsets


_DROPPED = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_SPACES = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u000b\u000c"


def plain_spaces(text: Column) -> Column:
    """Unusual spaces to plain ones, invisible characters gone, runs of spaces to one."""
    even = F.translate(text, _SPACES + _DROPPED, " " * len(_SPACES))
    return F.regexp_replace(even, " {2,}", " ")


def flags(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a unit that the classifier takes for residue."""
    found = np.zeros(len(offsets) - 1, bool)
    for (units, margin), mark in zip(model.margins(data, offsets), MARKS):
        found[units.doc[margin > mark]] = True
    return found


def _sample(every: DataFrame, total: int, n: int, labelled: int) -> list:
    """Rows (k, t, ...) of a bounded sample: about ``n`` by the hash of ``k``, and those of about ``labelled`` that weak labels mark."""
    share = lambda m: int(min(1.0, m / max(1, total)) * 1_000_000)
    place = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1_000_000))
    # by the key first: texts that are not drawn are not cleaned
    picked = every.filter(place < share(max(n, labelled))).withColumn("t", plain_spaces(F.col("t")))
    picked = picked.filter((F.col("t") != "") & (F.length("t") <= TRAIN_CHARS)).withColumn("__any", place < share(n))
    at = [c for c in picked.columns].index("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.asarray(batch.column("__any")).copy()
            for lo, _, (data, offsets) in _slices(batch, at):
                raw = data.tobytes()
                for kind, units in enumerate(find_units(data, offsets)):
                    found = np.abs(_labels(units, raw, kind == 0)) == 1
                    keep[lo + units.doc[found]] = True
            yield batch.filter(pa.array(keep)).drop_columns(["__any"])

    rows = picked.mapInArrow(run, every.schema) if labelled else picked.filter("__any").drop("__any")
    return sorted(rows.collect(), key=lambda r: (r["k"] is not None, r["k"], r["t"]))


def training_texts(docs: DataFrame, key: str, text: str, n: int = TRAIN_TEXTS, labelled: int = LABEL_TEXTS) -> list[str]:
    """The texts of the training sample, in the order of their keys. One pass over the texts."""
    every = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return [r["t"] for r in _sample(every, docs.count(), n, labelled)]


_COUNTS = ["texts", "units", "residue", "hit", "said", "right", "residue_texts", "hit_texts", "said_texts", "new_residue", "new_hit", "new_texts", "new_hit_texts"]


def validate(docs: DataFrame, key: str, text: str, host: str, folds: int = 5, n: int = TRAIN_TEXTS, labelled: int = 0, new: bool = False) -> list[dict]:
    """Held-out quality by host: the model never sees texts of the hosts it is measured on.

    A host's texts are in one fold. A fold's model is fitted on the bounded sample of the other
    folds; all texts of the fold are scored whole, by the rule of ``flags``, and compared with the
    weak labels of their units (mentions count as none): unit by unit, and text by text.

    With ``new``, a second model of each fold is also denied a share of the phrases and
    placeholders (by hash, every ``folds``-th); ``new_recall`` and ``new_text_recall`` are its
    recall on the units and texts of the fold's hosts whose only evidence is what it was denied.
    """
    every = docs.select(F.col(key).alias("k"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("h"), F.col(text).cast("string").alias("t"))
    every = every.select("k", "t", F.pmod(F.xxhash64("h"), F.lit(folds)).alias("fold"))
    sample = _sample(every, docs.count(), n, labelled)
    others = [[r["t"] for r in sample if r["fold"] != fold] for fold in range(folds)]
    denied = [None if not new else (lambda phrase, fold=fold: zlib.crc32(phrase.encode()) % folds == fold) for fold in range(folds)]
    models = [(train(texts), train(texts, d) if d else None) for texts, d in zip(others, denied)]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.asarray(batch.column(1))
            for fold in np.unique(of).tolist():
                mine = batch.filter(pa.array(of == fold))
                for _, _, spread in _slices(mine, 0):
                    tally = _tally(*shared.value[fold], *spread, denied[fold])
                    yield pa.RecordBatch.from_pydict({"fold": [fold], **{c: [v] for c, v in zip(_COUNTS, tally)}})

    scored = every.select(plain_spaces(F.col("t")).alias("t"), "fold").filter("t <> ''").mapInArrow(run, "fold long, " + ", ".join(f"{c} long" for c in _COUNTS))
    out = []
    for r in sorted(scored.groupBy("fold").agg(*[F.sum(c).alias(c) for c in _COUNTS]).collect(), key=lambda r: r["fold"]):
        ratio = lambda a, b: r[a] / r[b] if r[b] else None  # noqa: E731, B023
        out.append({
            "fold": r["fold"], "texts": r["texts"], "units": r["units"], "residue": r["residue"], "recall": ratio("hit", "residue"), "precision": ratio("hit", "said"),
            "accuracy": r["right"] / max(1, r["units"]), "residue_texts": r["residue_texts"], "text_recall": ratio("hit_texts", "residue_texts"), "text_precision": ratio("hit_texts", "said_texts"),
            "new_residue": r["new_residue"], "new_recall": ratio("new_hit", "new_residue"), "new_texts": r["new_texts"], "new_text_recall": ratio("new_hit_texts", "new_texts"),
        })
    return out


def _tally(model: Model, second: Model | None, data: np.ndarray, offsets: np.ndarray, denied) -> list[int]:
    """The counts of ``_COUNTS`` over the texts at ``offsets``."""
    labelled, flagged, old, fresh, caught = np.zeros((5, len(offsets) - 1), bool)
    sums = np.zeros(4, int)
    seen = new = new_hit = 0
    raw = data.tobytes()
    again = second.margins(data, offsets) if second else None
    for kind, (units, margin) in enumerate(model.margins(data, offsets)):
        label = _labels(units, raw, kind == 0)
        judged = label != _LEFT_OUT
        true, says = (label == 1)[judged], (margin > MARKS[kind])[judged]
        seen += int(judged.sum())
        sums += [true.sum(), (true & says).sum(), says.sum(), (true == says).sum()]
        labelled[units.doc[label == 1]] = True
        flagged[units.doc[margin > MARKS[kind]]] = True
        if again:
            caught[units.doc[again[kind][1] > MARKS[kind]]] = True
            for k in np.flatnonzero(label == 1):
                if denied(_evidence(*_unit(units, k, raw))):
                    fresh[units.doc[k]] = True
                    new, new_hit = new + 1, new_hit + bool(again[kind][1][k] > MARKS[kind])
                else:
                    old[units.doc[k]] = True
    only = fresh & ~old
    texts = [int(x.sum()) for x in (labelled, labelled & flagged, flagged)]
    return [len(labelled), seen, *sums.tolist(), *texts, new, new_hit, int(only.sum()), int((only & caught).sum())]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray]]]:
    """Where each slice of about 2 MB begins, how many texts it has, and their bytes and offsets; null as empty."""
    lo, lengths = 0, np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
    while lo < batch.num_rows:
        hi, size = lo, 0
        while hi < batch.num_rows and (hi == lo or size + lengths[hi] < 2_000_000):
            size += lengths[hi]
            hi += 1
        texts = batch.column(column).slice(lo, hi - lo).cast(pa.large_string()).fill_null("")
        _, at, content = texts.buffers()
        offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + hi - lo + 1]
        data = np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]] if content else np.zeros(0, np.uint8)
        yield lo, hi - lo, (data, offsets - offsets[0])
        lo = hi


def mark_residue(docs: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """``(key, residue)`` for every row: whether template residue stands in its text.

    Whole texts are scored, in one pass without a shuffle. Null, empty and blank texts have
    none. Repeated rows stay repeated; a null key is kept; an empty table gives an empty result
    (the seeds alone train the model then). Other columns are ignored.
    """
    model = model or train(training_texts(docs, key, text))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, spread in _slices(batch, 1):
                found = flags(shared.value, *spread)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(found)], ["k", "residue"])

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("k"), plain_spaces(F.col(text).cast("string")).alias("t"))
    return picked.mapInArrow(run, f"k {kind}, residue boolean").withColumnRenamed("k", key)
