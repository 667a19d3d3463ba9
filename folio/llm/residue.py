"""Left-over template, filler and server or browser messages instead of content (problem 9).

Texts are cut into segments (lines and sentences). Segments that hold a slot, filler or a phrase are masked - numbers,
addresses, ids, dates, the words of pseudo-Latin and repeats - and their exact normalised hashes are grouped over all
documents and sources. Phrase rules look at a segment before it is hashed, which leaves the rest out of the shuffle;
what they find is decided by how far it spreads:

* **recurring** (at least ``MIN_DOCS`` documents and ``MIN_SOURCES`` sources): a slot, filler or a *firm* phrase at the
  start of a sentence is residue wherever it stands; a *soft* phrase is where its block holds one of ``TRIGGERS``, the
  strict list.
* **single**: slots and filler count; a firm phrase counts only where it begins a line, as a message does that stands for
  itself; soft phrases don't.

A slot that is merely shown, that is, quoted by itself or after one word of greeting, is discussed and no residue;
neither is a phrase in the middle of a sentence.

Defined cases: null and blank texts are no case; repeated documents are judged each by itself; an unknown source
counts as one source.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.runtime import cut, read, ship, spread

MIN_DOCS, MIN_SOURCES = 4, 3
SALT = 8

SLOT = re.compile(
    r"\{\{[^{}]{0,60}\}\}|\{%[^%{}]{1,80}%\}|<%=?[^%<>]{1,80}%>|\$\{[^{}]{1,60}\}|%\(\w+\)[sd]|\{[A-Za-z]\w{2,40}\}"
    r"|\[\[[^\[\]|]{0,60}\|\s*TBD\s*\]?|\[INSERT\s[^\[\]]{1,60}\]|\[Your\s[^\[\]]{1,60}\]|\[[A-Z][A-Z_]{2,40}\]"
    r"|<<\s*\w+\s*>>|<[A-Z][A-Z_]*_HERE>|__[A-Z][A-Z_]*__|@@\w+@@|#[A-Z][A-Z_]{2,40}#|\$[A-Z][A-Z_]{2,40}\$|%[A-Z][A-Z_]{2,40}%"
    r"|«[A-Z][A-Z_]{2,40}»|TODO:\s+\w+|\|TBD\]"
)
SLOT_KEYS = ("{", "[", "<", "%(", "__", "@@", "#", "$", "TODO", "TBD", "«", "%")
SHOWN = re.compile("[“\"‘«„「『]\\s?(?:\\w+,? )?$"), re.compile("^\\s?[,.]?[”\"’»“」』]")

#: Firm phrases, at the start of a segment.
FIRM = re.compile(
    r"(?i)^(?:"
    r"<noscript>|(?:please )?(?:turn on|enable|activate|switch on) (?:javascript|scripts|cookies)|javascript (?:is (?:disabled|off|required|needed)|must be)"
    r"|this (?:site|page|app|website) (?:needs|requires|uses) (?:scripts|javascript|cookies)|you (?:must|need to|have to) (?:allow|enable|accept) (?:cookies|scripts|javascript)"
    r"|checking your browser|scripts must be active|enable it and reload|enable (?:javascript|cookies)|your browser (?:does not support|blocks)"
    r"|(?:http |error |http error )?(?:4\d\d|5\d\d)\s*(?:[–—:-]|error|not found|forbidden|エラー|bad gateway|internal)|error:? (?:code )?(?:4\d\d|5\d\d)|http (?:4\d\d|5\d\d)"
    r"|(?:page|file|document) not found|(?:we|sorry, we) (?:could|can)(?: ?not|n[’']t) find (?:the|this|that|/)|the (?:document|page|file|resource) \S+ (?:has been|was) (?:removed|deleted|moved)"
    r"|(?:the )?(?:service|site|server) (?:is )?(?:down|unavailable|temporarily|currently unavailable)|service unavailable|access (?:to \S+ )?(?:was |is )?(?:refused|denied|forbidden)"
    r"|your session (?:has )?(?:run out|expired|timed out)|you have reached your (?:reading|article|free)|this (?:item|content|video|page|article) is not (?:offered|available)"
    r"|sorry, something (?:broke|went wrong)|something went wrong|oops[!,.]|that link leads nowhere|bad request\b|fatal(?: error)?:|traceback \(most recent call last\)"
    r"|(?:java|javax|org)\.[\w.]+(?:exception|error)\b|\{\s*\"?error\"?\s*:|we are (?:having trouble|experiencing)|internal server error|bad gateway|gateway time-?out|too many requests"
    r"|this is (?:sample|placeholder|dummy|filler) text|(?:body copy|your text|text|content) goes here|put your (?:paragraph|text) in|dummy (?:content|text)\b|placeholder text|insert (?:your )?text here|lorem ipsum\b"
    r"|activez (?:javascript|les scripts)|cette page (?:exige|nécessite) |erreur (?:4\d\d|5\d\d)|acc[eè]s refusé|le service (?:ne répond pas|est indisponible)|ceci est un (?:faux )?texte|votre texte (?:viendra|ici)"
    r"|active javascript|esta página (?:necesita|requiere) |acceso denegado|el servicio no (?:responde|está disponible)|este es un texto de relleno|aquí (?:irá|va) (?:su|el|tu) (?:contenido|texto)"
    r"|bitte javascript|diese seite (?:braucht|benötigt|erfordert) |fehler (?:4\d\d|5\d\d)|zugriff (?:auf \S+ )?verweigert|der dienst ist (?:zurzeit|derzeit|momentan)|dies ist ein (?:blindtext|platzhalter)|hier steht (?:später|bald)"
    r"|请(?:启用|开启|打开)(?:javascript|脚本|cookie)|错误\s*(?:4|5)\d\d|服务(?:暂时)?不可用|此处为占位|拒绝访问|访问(?:被拒绝|受限)|这是(?:示例|占位)"
    r"|このページを(?:見る|表示する)には|(?:4|5)\d\d\s*エラー|ただいま(?:サーバー|アクセス)|これは(?:仮|ダミー)の|後で差し替え|アクセスが拒否"
    r"|यह पृष्ठ देखने के लिए|त्रुटि\s*(?:4|5)\d\d|सेवा अभी उपलब्ध नहीं|यह नमूना पाठ|पहुँच (?:अस्वीकृत|निषेध)"
    r"|โปรดเปิดใช้|ข้อผิดพลาด\s*(?:4|5)\d\d|ระบบปิดปรับปรุง|นี่คือข้อความ(?:ตัวอย่าง|จำลอง)|ข้อความตัวอย่าง|ไม่พบหน้า|ปฏิเสธการเข้าถึง"
    r")"
)
#: Soft phrases, anywhere in a segment; they need recurrence and a block with one of TRIGGERS.
SOFT = re.compile(r"(?i)javascript|\bscripts?\b|\bcookies?\b|\bbrowser|unavailable|maintenance|try again|reload|log in to|sign in|\baccess\b|\berror\b|not found|placeholder|sample text|エラー|サーバー|服务|占位|脚本|त्रुटि|सेवा|ระบบ|ข้อผิดพลาด|ข้อความ")
#: The strict list: words one of which a block must hold for its soft phrases to count. No other rule asks for them.
TRIGGERS = (
    "javascript", "script", "cookie", "browser", "404", "403", "500", "502", "503", "429", "not found", "could not find", "removed or", "service is", "unavailable", "refused", "denied",
    "session", "reading limit", "not offered", "not available", "something", "oops", "nowhere", "bad request", "fatal", "traceback", "exception", "\"error\"", "trouble loading", "gateway",
    "too many requests", "sample text", "goes here", "paragraph in", "dummy", "placeholder", "lorem", "ipsum", "erreur", "refusé", "service ne", "faux texte", "votre texte",
    "relleno", "denegado", "servicio no", "aquí irá", "blindtext", "richtige text", "fehler", "verweigert", "dienst ist", "skripte", "脚本", "错误", "服务", "占位", "拒绝", "エラー", "サーバー",
    "仮の", "差し替え", "アクセス", "ページ", "त्रुटि", "सेवा अभी", "नमूना", "पृष्ठ", "โปรดเปิด", "ข้อผิดพลาด", "ระบบปิด", "ข้อความ", "ปฏิเสธ", "ตัวอย่าง",
)
LOREM = set(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua quis nostrud ullamco fugiat nulla pariatur arcu morbi porta nunc nisl orci "
    "quam tellus viverra sodales sodal viver erat vel velit massa mauris turpis vitae purus".split()
)
ENDS = re.compile(r"\n\s*\n|(?<=[.!?…।])\s+|(?<=[。！？])|\n|(?<=[\u0e00-\u0e7f]) +(?=[\u0e00-\u0e7f])")
_STOPS = re.compile(r"(?<=[.!?…।])\s+|(?<=[。！？])")
_WORD = re.compile(r"[^\W\d_]+")
_MASKS = (
    (re.compile(r"https?://\S+|\bwww\.\S+|\S+@\S+\.\w+|/[\w./-]+"), "<addr>"),
    (re.compile(r"\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d)?)?|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b"), "<date>"),
    (re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b"), "<id>"),
    (re.compile(r"\d+(?:[.,]\d+)*"), "0"),
)


def mask(segment: str) -> str:
    """Normal form of a segment: addresses, dates, ids and numbers masked, no case, single spaces."""
    for pattern, by in _MASKS:
        segment = pattern.sub(by, segment)
    return " ".join(segment.lower().split())


def slots(text: str) -> list[str]:
    """Unfilled slots that aren't merely shown."""
    if not any(k in text for k in SLOT_KEYS):
        return []
    out = []
    for m in SLOT.finditer(text):
        before, after = SHOWN
        if before.search(text, max(0, m.start() - 24), m.start()) and after.search(text[m.end() : m.end() + 4]):
            continue
        out.append(m.group())
    return out


def filler(block: str) -> bool:
    """Pseudo-Latin, or one token over and over."""
    words = _WORD.findall(block.lower())
    if len(words) >= 6:
        known = [w for w in words if w in LOREM]
        if len(known) >= 4 and len(known) >= 0.25 * len(words) and len(set(known)) >= 3 and not re.search(r"\d", block) and ("lorem" in words or "ipsum" in words or len(known) >= 0.35 * len(words)):
            return True
    return repeated(block)


def repeated(block: str) -> bool:
    """One or two words over and over, six or more in all; break marks are no words."""
    tokens = block.split()
    if len(tokens) < 6 or len(set(tokens)) > 6:
        return False
    bare = Counter(t.strip(".,;:!?-–…").lower() for t in tokens)
    top = [(w, n) for w, n in bare.most_common(2) if w and w[0].isalpha() and n >= 3]
    return sum(n for _, n in top) >= 0.8 * len(tokens)


def plain_filler(block: str) -> str:
    """Normal form of filler: pseudo-Latin as such, other words once each in the order of the alphabet."""
    words = set(_WORD.findall(block.lower()))
    return "<filler> " + ("<latin>" if len(words & LOREM) >= 3 else " ".join(sorted(words)))


SEGMENTS = "doc_id long, source string, reason string, line boolean, h long, masked string"


def judge(text: str) -> list[tuple[str, str]]:
    """(reason, segment) for what in a text may be residue; reasons 'slot', 'filler' and 'firm' are certain, 'soft' isn't."""
    out = [("slot", s) for s in slots(text)]
    out += [("filler", block) for block in text.replace("\n \n", "\n\n").split("\n\n") if repeated(block)]
    small = text.lower()
    somewhere = any(k in small for k in TRIGGERS)  # lower case keeps all triggers of a block in the text
    for block in re.split(r"\n\s*\n", text):
        if filler(block):
            out.append(("filler", block))
            continue
        low = block.lower() if somewhere else ""
        strict = somewhere and any(k in low for k in TRIGGERS)
        for segment in ENDS.split(block):
            s = " ".join(segment.split())
            if not s:
                continue
            if FIRM.match(s):
                out.append(("firm", s))
            elif strict and SOFT.search(s):
                out.append(("soft", s))
    if "\n" in text.strip() and not any(r in ("firm", "filler") for r, _ in out):  # a message over several lines
        for segment in _STOPS.split(text):
            if "\n" in segment.strip():
                s = " ".join(segment.split())
                if FIRM.match(s):
                    out.append(("firm", s))
    return out


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
            found = judge(text)
            lines = {" ".join(x.split()) for x in text.split("\n")} - {""} if any(r == "firm" for r, _ in found) else set()
            for reason, segment in set(found):
                m = plain_filler(segment) if reason == "filler" else mask(segment)
                line = reason == "firm" and any(x.startswith(segment) or segment.startswith(x) for x in lines)
                rows.append((doc, source, reason, line, np.uint64(xxhash.xxh64_intdigest(m)).astype(np.int64), m))
        yield pd.DataFrame(rows, columns=["doc_id", "source", "reason", "line", "h", "masked"]).astype({"doc_id": np.int64, "h": np.int64, "line": bool})


def residue_segments(documents: DataFrame) -> DataFrame:
    """Suspicious segments with the number of documents and sources in which their masked form stands, and their class:
    'recurring' or 'single'; ``residue`` tells those that are residue."""
    ship(documents.sparkSession)
    source = F.coalesce(F.regexp_replace(F.lower(F.trim("source")), "[^a-z0-9]+", "_"), F.lit("?"))
    docs = spread(documents.where("doc_id is not null and text is not null and trim(text) <> ''").select("doc_id", source.alias("source"), "text"))
    seen = cut(docs.mapInPandas(_segments, SEGMENTS))  # read twice: for the widths and for the documents
    widths = seen.groupBy("h").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("source").alias("n_sources"))
    # a widespread message has its rows in SALT tasks
    salted = seen.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    wide = widths.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    out = salted.join(wide, ["h", "_salt"]).drop("_salt")
    recurs = (F.col("n_docs") >= MIN_DOCS) & (F.col("n_sources") >= MIN_SOURCES)
    alone = F.col("reason").isin("slot", "filler") | ((F.col("reason") == "firm") & F.col("line"))
    return out.withColumn("class", F.when(recurs, "recurring").otherwise("single")).withColumn("residue", recurs | alone)


def residue(documents: DataFrame) -> DataFrame:
    """doc_id, the reasons and the classes of every document that holds residue."""
    found = residue_segments(documents).where("residue")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("doc_id").agg(listed("reason").alias("reasons"), listed("class").alias("classes"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds left-over template, filler or a server or browser message."""
    return residue(read(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id")


def p9_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked messages with their spread over documents and sources, their class, and whether they are residue."""
    found = residue_segments(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return found.groupBy("h").agg(F.min("masked").alias("masked"), F.min("reason").alias("reason"), F.max("n_docs").alias("n_docs"), F.max("n_sources").alias("n_sources"), F.max("class").alias("class"), F.max("residue").alias("residue")).drop("h")
