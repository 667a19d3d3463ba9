"""Sentence units in eight languages: candidate boundaries classified by a maximum-entropy model (problem 3).

``places`` walks a text once. A candidate is an end mark at quotation depth 0 together with the closing
quotes and brackets behind it; marks inside a quotation are never candidates, so a quotation stays with the words
around it. In Thai script every space is a candidate. Each candidate gets maximum-entropy features (the token before
it, its shape and class, the token behind it, the next character's class and script, case, digits, the length of the
sentence so far, reporting clauses) and a logistic model decides.

All weights start at zero; nothing is set by hand. They are fitted on the driver on two kinds of evidence:

* **Ends of units.** No sentence reaches beyond its unit, so where a stored unit ends a sentence ends, whatever its
  characters look like. Each unit of a bounded sample (``TRAIN_ROWS``) is joined with the next one of its document; the
  candidate at the join is a reliable boundary, with features from both sides. The candidates inside a unit have no
  label: each is a boundary with a probability that expectation maximisation finds together with the weights. A boundary
  happens to be a unit's end with a chance ``c`` of its script; what hardly ever stands at an end where ``c`` would make
  it do so isn't one. No label is made from a feature that the classifier sees.
* **Seeds.** ``SEED``, some hand-cut lines in the eight languages, so that a handful of paragraphs is enough to start from.

Defined cases: null or blank text has no sentence; a text without letters or digits (mere break marks) has none; a
heading is one sentence; a text without end marks is one sentence. Offsets count code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.rangejoin import point_in_interval
from folio.runtime import read, ship

TRAIN_ROWS = 6000
OPEN = {"“": "”", "„": "“", "«": "»", "‘": "’", "「": "」", "『": "』", "‹": "›"}
CLOSE = set("”’»」』›“\"')）]】")
MARK = re.compile(r"[.!?…。！？।॥]+")
TITLES = set("mr mrs ms dr prof hon gen capt rev col lt sgt st sr sra srta dra lic ing hr fr mme mlle mgr gov sen डॉ श्री".split())
NUMBER_WORDS = set("no nr vol p pp art sec abs pág pag fig ch num núm subsec km ca approx aprox".split())
MIDDLE = set("cf vs v etc incl mio mrd bzw usw viz resp ex e.g i.e al".split())
TIMES = {"p.m", "a.m"}
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember".split())
REPORTING = re.compile(r"说|問|问|道|答|喊|回答|पूछा|कहा|बोल|उत्तर")
HEADING = re.compile(r"(?i)^(#{1,6}\s|(chapter|section|part|book|act|scene|article|kapitel|chapitre|capítulo)\s+[\divxlc]+\b|§\s*\d+|[ivxlc]+\.\s|\([a-z]\)\s|\d+(\.\d+)*\.?(\s|$))")

#: Lines cut by hand, "|" where a sentence ends.
SEED = """
The gate was closed. |1804 brought rain. |Nobody came. |The rain went on… |Was it late? |It was! |She left in 1902. |He stayed.
Mr. Hall met Dr. Mary Lowe and Prof. Ahn. |They spoke with Gen. Orr and Mrs. Pike. |Hon. Tate agreed.
J. R. Moss and A. Bell wrote it. |K. Lane read it. |It weighs 3.5 t. |No. 12 is here, see Vol. 3, p. 40. |Sec. 7 holds.
They came at 6 p.m. |The shop shut. |He rose at 5 a.m. and left. |At 9 a.m. Ann ate. |At 7 p.m. Tom slept.
In Bell v. Stone, No. 4, it was so. |See id. at 8; cf. Rowe v. Finch. |E.g. this, i.e. that, etc. and so on.
“Go now. Run,” he said. |“Why?” she asked. |“It is over.” |“Come!” cried Capt. Reed. |Then (see p. 4) it ended.
It has 90 rows.|Its lid is lost. |The U.S. Mint paid. |Ships vs. Trains is a book. |About 4 km. north lies a hill.
Das Haus steht leer. |Es regnet. |Nach Abs. 3 gilt es, d. h. nicht immer, z. B. heute. |Am 4. Mai kam er. |Herr Dr. Kurz ging.
„Wer war es?“, fragte Jan. |„Niemand.“ |Etwa 5 Mio. Mark fehlten. |Nr. 7 ist weg. |Die Länge beträgt 20 m. |Wurde es hell? |Am 12. Juni war Ruhe.
La porte est close. |Il pleut. |M. Roux vit Mme Blanc. |« Qui est là ? » demanda Paul. |« Personne. » |Selon l’art. 5, p. ex. ici, c’est non. |Pourquoi ?
La puerta está cerrada. |—¿Quién va? —preguntó Ana. |¡Vamos! |¿Por qué? |Sra. Gil y Dr. Paz vinieron. |Según la pág. 6, aprox. el 2,5 %, no. |El art. 8 dice.
—¡Corre! —gritó Luis. |—No —dijo ella. |La casa costó 4,5 millones! |Lic. Rey firmó.
门关了。|下雨了！|谁在那里？|李问：“谁？” |“走吧。”王说，“快点。”|“好了。”他回答。|一八年高七米。|“来吧！”张喊道。|“好。”|1902年有雨。|李问：“谁？”|12人来了。
門は閉じた。|雨が降る。|「誰か。行こう」と彼は言った。|なぜか？|「はい」と答えた。|「急げ！」と叫んだ。|彼は来た。
द्वार बंद है। |वर्षा हुई। |“कौन है?” राम ने पूछा। |डॉ. सिंह आए। |“चलो!” उसने कहा। |क्यों? |वह गया।
ประตูปิดแล้ว |ฝนตกหนัก |สูงราว 7.5 เมตรและเก่า |เขามาเมื่อปี 2450 แล้วกลับ |ไม่มีใครอยู่
""".strip().splitlines()


def is_break(text: str | None) -> bool:
    """Whether the text alone marks a scene break: mere marks, or a heading of at most twelve words."""
    if not text or not text.strip():
        return False
    if not any(c.isalnum() for c in text):
        return True
    words = text.split()
    if len(words) > 12:
        return False
    letters = [c for c in text if c.isalpha()]
    upper = bool(letters) and all(c == c.upper() and c.lower() != c for c in letters)
    return upper or bool(HEADING.match(text.strip()) and not re.search(r"[.!?…。！？।]$", re.sub(r"^\S+\s*", "", text.strip()) or "x"))


def _script(c: str) -> str:
    o = ord(c)
    if 0x0E00 <= o <= 0x0E7F:
        return "thai"
    if 0x0900 <= o <= 0x097F:
        return "deva"
    if 0x3040 <= o <= 0x30FF:
        return "kana"
    if 0x3400 <= o <= 0x9FFF:
        return "han"
    return "latin"


def quotations(text: str) -> list[tuple[int, int]]:
    """Outermost closed quotations [open, close]; an opener that is never closed counts as no quotation."""
    spans, stack, n = [], [], len(text)
    for i, c in enumerate(text):
        if c in "“”„«»‘’「」『』‹›\"":
            if stack and c == stack[-1][1] and not (c == "’" and i + 1 < n and text[i + 1].isalpha() and i and text[i - 1].isalpha()):
                start, _ = stack.pop()
                if not stack:
                    spans.append((start, i))
            elif c == '"':
                stack.append((i, '"'))
            elif c in OPEN:
                if c == "‘" and i and text[i - 1].isalnum():
                    continue
                stack.append((i, OPEN[c]))
    if stack:  # what stays open hides the quotations inside it: look at them again without it
        first = stack[0][0]
        spans = [s for s in spans if s[1] < first]
        spans += [(a + first + 1, b + first + 1) for a, b in quotations(text[first + 1 :])]
    return spans


_QUOTE_CHARS = re.compile("[“”„«»‘「『‹\"]")
_THAI = re.compile("[฀-๿]")
_TOKEN = re.compile(r"\S+$")
_NEXT = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*")


class Model:
    """Feature weights; unseen features weigh nothing."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.memo: dict[tuple, bool] = {}

    def __reduce__(self):
        return Model, (self.weights,)

    def decide(self, feats: tuple[str, ...]) -> bool:
        hit = self.memo.get(feats)
        if hit is None:
            w = self.weights
            hit = sum(w.get(f, 0.0) for f in feats) > 0
            if len(self.memo) < 200_000:
                self.memo[feats] = hit
        return hit


def _features(text: str, a: int, b: int, end: int, start: int, last: int, quotes: list[tuple[int, int]], known=None) -> tuple[tuple[str, ...], bool | None]:
    """Features of the mark text[a:b] whose closers end at ``end``; ``start`` is where the next sentence would
    begin, ``last`` where the present one began. Tokens behind it only if their feature is ``known`` (all if that is
    None). Also what rules would say where they are sure, which no fit reads: tests hold the model against it."""
    mark, n = text[a:b], len(text)
    strong = mark != "."
    quoted = end > b or any(c in "”»」’" for c in text[b:end])
    feats = ["bias"]
    m = _TOKEN.search(text, max(last, a - 40), a)
    raw = m.group() if m else ""
    raw = re.split("[’'](?=[^\\W\\d])", raw)[-1]
    token = raw.lstrip("(“‘„«\"'—¿¡[").lower()
    nxt = text[start] if start < n else ""
    glued = start == end
    if not nxt:
        kind = "end"
    elif nxt in ",;:)）»”、，；：%":
        kind = "punct"
    elif nxt in "—–-":
        after = text[start + 1 : start + 2]
        kind = "dashlower" if after.islower() else "dashother"
    elif nxt in "“„«‘「『\"":
        kind = "open"
    elif nxt in "¿¡":
        kind = "invert"
    elif nxt in "([（":
        kind = "paren"
    elif nxt.isdigit():
        kind = "digit"
    elif nxt.islower():
        kind = "lower"
    elif nxt.isupper():
        kind = "upper"
    elif nxt.isalpha():
        kind = "script"
    else:
        kind = "other"
    feats.append("next=" + kind)
    if kind == "script":
        feats.append("script=" + _script(nxt))
    word = _NEXT.match(text, start)
    follow = word.group().lower() if word else ""
    if follow and kind != "script" and (known is None or "follow=" + follow in known):
        feats.append("follow=" + follow)
    feats.append("length=" + ("s" if a - last < 8 else "m" if a - last < 24 else "l"))
    label: bool | None = None
    klass = "none"
    if strong:
        feats.append("mark=strong")
    else:
        bare = token.rstrip(".")
        if len(bare) == 1 and raw[-1:].isupper():
            pass  # an initial, also where the letter is an abbreviation in lower case
        elif bare in TITLES:
            klass = "title"
        elif bare in TIMES:
            klass = "time"
        elif bare in NUMBER_WORDS:
            klass = "number"
        elif bare in MIDDLE:
            klass = "middle"
        if klass == "number":
            feats.append("class=number," + (kind if kind in ("digit", "upper") else "other"))
        elif klass == "time":
            feats.append("class=time")
            if len(text[last:a].split()) <= 3:
                feats.append("class=time,short")
        elif klass != "none":
            feats.append("class=" + klass)
        letters = raw.lstrip("(“‘„«\"'—¿¡[")
        if len(letters) == 1 and letters.islower() and re.search(r"\d\s$", text[max(0, a - 3) : a - 1]):
            feats.append("shape=unit")  # a figure with its unit
        elif len(letters) == 1 and letters.isalpha() and raw[:1] != "(" and _script(letters) == "latin" and klass == "none":
            feats.append("shape=initial")
            klass = "initial"
        elif "." in letters[:-1] and not any(c.isdigit() for c in letters) and klass == "none":
            feats.append("shape=innerdot")
            if kind == "digit":
                feats.append("innerdot,digit")
            klass = "innerdot"
        elif letters.isdigit():
            feats.append("shape=digits")
            if follow in MONTHS:
                feats.append("month")
                klass = "month"
        elif letters[-1:].isalpha():
            feats.append(f"shape={'upper' if letters[:1].isupper() else 'lower'}{min(4, len(letters))}")
        if len(token) <= 8:
            feats.append("token=" + token)
        if glued and kind in ("lower", "digit"):
            feats.append("glued," + kind)
    if quoted:
        feats.append("quoted")
        q = next((s for s in reversed(quotes) if s[1] < end and s[1] >= a - 1), None)
        if q and q[0] <= last + 1 and kind in ("script", "other"):
            stop = re.search("[。！？।?!“「]", text[start:])
            clause = text[start : start + stop.start()] if stop else text[start:]
            if follow and REPORTING.search(clause):
                feats.append("report")
                label = False
        if nxt == "と":
            feats.append("to")
            label = False
    if kind == "upper" and glued and not strong and len(token) <= 1:
        feats.append("glued,lower")
    # Reliable labels
    if kind in ("lower", "punct", "dashlower") or klass in ("title", "initial", "middle", "month") or (klass == "number" and kind == "digit"):
        label = False
    elif label is None and kind in ("upper", "open", "invert", "dashother", "script") and (strong or (klass == "none" and len(token) >= 4 and token[-1:].isalpha())):
        label = True
    return tuple(feats), label


def _touches_figure(text: str, a: int, b: int) -> tuple[str, ...]:
    left, right = text[a - 1], text[b]
    side = lambda c: "digit" if c.isdigit() else "thai" if _script(c) == "thai" else "other"
    return ("space", "before=" + side(left), "behind=" + side(right), f"around={'figure' if 'digit' in (side(left), side(right)) else 'words'}")


def places(text: str) -> tuple[list[tuple[int, int, int, int, bool]], list[tuple[int, int]], int]:
    """Candidates (mark's start and end, end with closers, start of what follows, whether it is a space of a Thai text),
    the quotations, and where the text begins."""
    n = len(text)
    first = 0
    while first < n and text[first].isspace():
        first += 1
    quotes = quotations(text) if _QUOTE_CHARS.search(text) else []
    closing = {s[1] for s in quotes}
    stops: list[tuple[int, int, bool]] = [(m.start(), m.end(), False) for m in MARK.finditer(text)]
    if _THAI.search(text):
        for m in re.finditer(r"\s+", text):
            a, b = m.span()
            if first < a and b < n and ("฀" <= text[a - 1] <= "๿" or "฀" <= text[b] <= "๿"):
                stops.append((a, b, True))
        stops.sort()
    out, qi, free = [], 0, first
    for a, b, space in stops:
        if a < free:
            continue
        while qi < len(quotes) and quotes[qi][1] < a:
            qi += 1
        inside = qi < len(quotes) and quotes[qi][0] < a < quotes[qi][1]
        if space:
            if not inside:
                out.append((a, b, a, b, True))
            continue
        end = b
        if inside:
            close = quotes[qi][1]
            if text[b:close].strip():
                continue  # more follows within the quotation
            end = close + 1
        while end < n and text[end] in CLOSE and not (text[end] in "“\"" and end not in closing):
            end += 1
        start = end
        while start < n and text[start].isspace():
            start += 1
        if start >= n:
            continue
        if start == end and text[a:b] == "." and a and text[a - 1].isdigit() and text[start].isdigit():
            continue  # a decimal
        out.append((a, b, end, start, False))
        free = start
    return out, quotes, first


def walk(text: str, model: Model, collect: list | None = None, trace: list | None = None) -> list[tuple[int, int]]:
    """Sentence spans of one paragraph that is no break. collect: gets (features, sure label); trace: gets (start of
    what follows, features, script) of every candidate."""
    stops, quotes, first = places(text)
    n = len(text)
    if first == n:
        return []
    out, last, known = [], first, None if trace is not None else model.weights
    for a, b, end, start, space in stops:
        if a < last:
            continue
        feats, label = (_touches_figure(text, a, b), None) if space else _features(text, a, b, end, start, last, quotes, known)
        if collect is not None and label is not None:
            collect.append((feats, label))
        if trace is not None:
            trace.append((start, feats, _script(text[a - 1]) if a else "latin"))
        if model.decide(feats):
            out.append((last, end))
            last = start
    tail = n
    while tail > last and text[tail - 1].isspace():
        tail -= 1
    if tail > last:
        out.append((last, tail))
    return out


def split(text: str | None, flag: bool | None, model: Model) -> list[tuple[int, int]]:
    """Sentence spans of a paragraph or unit; ``flag`` is its scene-break flag, if known."""
    if not text or not any(c.isalnum() for c in text):
        return []
    if flag or (flag is None and is_break(text)):
        a = len(text) - len(text.lstrip())
        return [(a, len(text.rstrip()))]
    return walk(text, model)


class _Always(Model):
    """Cuts at every candidate; what the first round of the fit begins with."""

    def __init__(self):
        super().__init__({})

    def decide(self, feats: tuple[str, ...]) -> bool:
        return True


def _joined(text: str, following: str) -> tuple[str, int]:
    """Two paragraphs in one text, and where the second one begins."""
    body = text.rstrip()
    body += "" if _script(body.rstrip("。！？”」』…")[-1:] or "a") in ("han", "kana") else " "
    return body + following.lstrip(), len(body)


def _evidence(pairs: list[tuple[str, str | None]], model: Model) -> list[tuple[tuple[str, ...], str, float | None, float]]:
    """(features, script, label - None if unknown -, how often) of the candidates of texts and seeds."""
    out: Counter = Counter()
    for line in SEED:
        text, ends = "", set()
        for part in re.split(r"\s?\|", line):
            if text:
                glued = line[len(text) + len(ends) :][:1] == "|" or _script(text.rstrip("。！？”」』…")[-1:] or "a") in ("han", "kana")
                text += "" if glued else " "
                ends.add(len(text))
            text += part
        trace: list = []
        walk(text, model, trace=trace)
        out.update((f, "seed", float(start in ends)) for start, f, _ in trace)
    for text, following in pairs:
        whole, at = _joined(text, following) if following else (text, len(text) + 2)
        trace = []
        walk(whole, model, trace=trace)
        out.update((f, script, 1.0 if start == at else None) for start, f, script in trace if start <= at)
    return [(*k, float(n)) for k, n in out.items()]


def _ascend(ri, ci, y, times, w, rounds: int, strength: np.ndarray):
    """Weights of greatest likelihood for soft labels, under a Gaussian prior around zero (Adagrad)."""
    grad2 = np.full(len(w), 1e-8)
    for _ in range(rounds):
        z = np.bincount(ri, weights=w[ci], minlength=len(y))
        g = np.bincount(ci, weights=(times * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y))[ri], minlength=len(w)) + strength * w
        grad2 += g * g
        w = w - 0.5 * g / np.sqrt(grad2)
    return w


def _maximise(rows: list, rounds: int, strength: float, steps: int) -> Model:
    counts: Counter = Counter()
    for feats, *_, n in rows:
        for f in feats:
            counts[f] += n
    rare = lambda f: f.startswith(("token=", "follow=")) and counts[f] < 5
    names = {f: i for i, f in enumerate(sorted(f for f in counts if not rare(f)))}
    flat = [(r, names[f]) for r, (feats, *_) in enumerate(rows) for f in feats if f in names]
    ri, ci = np.array([x for x, _ in flat]), np.array([x for _, x in flat])
    open_ = np.array([label is None for _, _, label, _ in rows])
    y = np.array([0.5 if label is None else label for _, _, label, _ in rows])
    script, times = np.array([s for _, s, _, _ in rows]), np.array([n for *_, n in rows])
    w = np.zeros(len(names))
    hold = np.array([strength * (20 if f.startswith(("token=", "follow=")) else 1) for f in names])  # single words are held tighter
    groups = [script == s for s in set(script.tolist()) - {"seed"}]
    for g in groups:  # to begin with: as many boundaries again as there are ends of paragraphs
        ends, rest = float(times[g & ~open_].sum()), float(times[g & open_].sum())
        y[g & open_] = min(0.5, 2.0 * ends / rest) if rest else 0.0
    for step in range(steps):
        w = _ascend(ri, ci, y, times, w, rounds, hold)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(ri, weights=w[ci], minlength=len(y)), -30, 30)))
        for g in groups:
            ends = float(times[g & ~open_].sum())
            c = min(0.95, ends / max(1.0, ends + float((times * y)[g & open_].sum())))
            y[g & open_] = ((1 - c) * p / (1 - c * p))[g & open_]
    return Model({f: round(float(w[i]), 6) for f, i in names.items()})


def fit(texts: list[str], following: list[str | None] | None = None, rounds: int = 60, strength: float = 0.05, steps: int = 12) -> Model:
    """Maximum-entropy weights from the ends of texts (units or paragraphs) and the seeds. following: the one behind each
    text, by default the next text of the list; None where it isn't known. Two rounds: the sentence so far, which is a feature,
    is first cut at every candidate and then by the model of the first round."""
    following = [*texts[1:], None] if following is None else following
    pairs = [(t, f if f and f.strip() and not is_break(f) else None) for t, f in zip(texts, following) if t and t.strip() and not is_break(t)]
    model: Model = _Always()
    for _ in range(2):
        model = _maximise(_evidence(pairs, model), rounds, strength, steps if pairs else 1)
    return model


def train(units: DataFrame | None, rows: int = TRAIN_ROWS) -> Model:
    """Model fitted on at most ``rows`` units, picked by a hash of their key, each with the next one of its document; on
    the seeds alone where there are no units."""
    if units is None:
        return fit([])
    text = F.array_join("items.sentence", " ", "")
    own = units.where("items is not null and doc_id is not null and unit_idx is not null").select("doc_id", "unit_idx", text.alias("text"), F.coalesce("is_scene_break", F.lit(False)).alias("apart"))
    pick = own.withColumn("o", F.xxhash64("doc_id", "unit_idx")).orderBy("o", "doc_id", "unit_idx", "text").limit(rows).collect()
    first: dict[tuple, object] = {}
    for r in pick:
        if not r["apart"]:
            first.setdefault((r["doc_id"], r["unit_idx"]), r["text"])
    if not first:
        return fit([])
    places = units.sparkSession.createDataFrame([(d, i, i + 1) for d, i in first], "doc_id long, place int, unit_idx int")
    got = own.join(F.broadcast(places), ["doc_id", "unit_idx"]).where("not apart").groupBy("doc_id", "place").agg(F.max("text").alias("text")).collect()
    behind = {(r["doc_id"], r["place"]): r["text"] for r in got}
    return fit(list(first.values()), [behind.get(k) for k in first])


SENTENCES = "record_kind string, doc_id long, record_idx long, sent_start long, sent_end long"


def _emit(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds, docs, idxs, starts, ends = [], [], [], [], []
            for kind, doc, idx, parts, flags in zip(pdf["record_kind"], pdf["doc_id"], pdf["record_idx"], pdf["parts"], pdf["flags"]):
                base = 0
                for text, flag in zip(parts, flags):
                    for a, b in split(text, None if flag is None or flag != flag else bool(flag), model):
                        kinds.append(kind)
                        docs.append(doc)
                        idxs.append(idx)
                        starts.append(base + a)
                        ends.append(base + b)
                    base += len(text or "") + 1
            yield pd.DataFrame({"record_kind": kinds, "doc_id": np.array(docs, np.int64), "record_idx": np.array(idxs, np.int64), "sent_start": np.array(starts, np.int64), "sent_end": np.array(ends, np.int64)})

    return run


def paragraph_records(paragraphs: DataFrame) -> DataFrame:
    """One row per (doc_id, para_idx); of repeated rows the greatest values count."""
    return paragraphs.groupBy("doc_id", "para_idx").agg(F.max("text").alias("text"), F.max("is_scene_break").alias("is_scene_break"), F.max("char_offset").alias("char_offset"))


def chunk_paragraphs(chunks: DataFrame, paragraphs: DataFrame, longer_than: int = -1) -> DataFrame:
    """Chunks (one row a key, of more than ``longer_than`` characters) with their paragraphs in order: by ``paragraph_indices`` or, where that is null, by
    the offsets. Columns: doc_id, chunk_idx, text, char_start, paras array<struct<para_idx, text, is_scene_break, char_offset>>."""
    one = chunks.groupBy("doc_id", "chunk_idx").agg(F.max("text").alias("text"), F.max("paragraph_indices").alias("ids"), F.max("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    one = one.where(F.length("text") > longer_than)
    p = paragraph_records(paragraphs).select("doc_id", "para_idx", F.col("text").alias("p_text"), "is_scene_break", "char_offset")
    entry = F.struct("para_idx", F.col("p_text").alias("text"), "is_scene_break", "char_offset")
    keys = one.select("doc_id", "chunk_idx", "ids", "char_start", "char_end")
    listed = keys.where("ids is not null").select("doc_id", "chunk_idx", F.explode("ids").alias("para_idx")).join(p, ["doc_id", "para_idx"])
    ranged = point_in_interval(p, keys.where("ids is null").drop("ids"), ["doc_id"], "char_offset", "char_start", "char_end")
    both = listed.select("doc_id", "chunk_idx", entry.alias("e")).unionByName(ranged.select("doc_id", "chunk_idx", entry.alias("e")))
    lists = both.groupBy("doc_id", "chunk_idx").agg(F.array_sort(F.collect_set("e")).alias("paras"))
    return one.select("doc_id", "chunk_idx", "text", "char_start").join(lists, ["doc_id", "chunk_idx"], "left")


def _breaks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks without a scene break, as the list of their parts."""
    for pdf in batches:
        keep, parts = [], []
        for text, paras in zip(pdf["text"], pdf["paras"]):
            own = [] if paras is None else list(paras)
            broken = any((p["is_scene_break"] if p["is_scene_break"] is not None else is_break(p["text"])) for p in own)
            keep.append(not broken and bool(text))
            cut = [p["text"] or "" for p in own]
            parts.append(cut if " ".join(cut) == text else [text or ""])
        pdf = pdf.assign(parts=parts)[np.array(keep, bool)]
        yield pd.DataFrame({"record_kind": "chunk", "doc_id": pdf["doc_id"], "record_idx": pdf["chunk_idx"].astype("int64"), "parts": pdf["parts"], "flags": [[False] * len(x) for x in pdf["parts"]]})


PARTS = "record_kind string, doc_id long, record_idx long, parts array<string>, flags array<boolean>"


def sentences(spark: SparkSession, paragraphs: DataFrame, chunks: DataFrame, units: DataFrame) -> DataFrame:
    """Sentences of every paragraph, break-free chunk and unit."""
    ship(spark)
    model = train(units)
    p = paragraph_records(paragraphs).select(F.lit("paragraph").alias("record_kind"), "doc_id", F.col("para_idx").cast("long").alias("record_idx"), F.array("text").alias("parts"), F.array("is_scene_break").alias("flags"))
    c = chunk_paragraphs(chunks, paragraphs).mapInPandas(_breaks, PARTS)
    u = units.groupBy("doc_id", "unit_idx").agg(F.max(F.col("items.sentence")).alias("s"), F.max("is_scene_break").alias("is_scene_break"))
    u = u.where("s is not null").select(F.lit("unit").alias("record_kind"), "doc_id", F.col("unit_idx").cast("long").alias("record_idx"), F.array(F.array_join("s", " ", "")).alias("parts"), F.array("is_scene_break").alias("flags"))
    return p.unionByName(c).unionByName(u).mapInPandas(_emit(model), SENTENCES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every paragraph, chunk and unit with its offsets."""
    return sentences(
        spark,
        read(spark, sf_dir, "paragraph", "doc_id", "para_idx", "text", "is_scene_break", "char_offset"),
        read(spark, sf_dir, "chunk", "doc_id", "chunk_idx", "text", "paragraph_indices", "char_start", "char_end"),
        read(spark, sf_dir, "semantic_unit", "doc_id", "unit_idx", "items", "is_scene_break"),
    )
