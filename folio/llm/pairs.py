"""Defective input/target pairs with their type of defect (problem 5).

* **Shortened versions.** A text that breaks off is the beginning of something longer. What is compared is the last
  sentence of each target with the whole sentences of all targets and passages, by their *forms*: figures are masked, and
  so is every word that stands in less than ``FORM_SHARES`` of the texts, so that sentences about other things can be
  neighbours. All forms are range-sorted, and each last sentence - whole, without what trails behind it, and without its
  last one to three tokens - is compared with the whole sentence that follows it in the order:

  - ``whole``: the form is that of a whole sentence elsewhere; the target is complete, however it looks;
  - ``shortened``: the form (or the form but for a last, half-written token) goes on in a neighbour; the target is cut;
  - ``astray``: neighbours share all but the last tokens, where the target leaves them; it is cut if it lacks a proper end;
  - unknown: no neighbour says anything.
* **Length limits.** Lengths at which far more targets end than at the lengths around are limits.
* **Rules.** One defect a pair, the first that holds: 'empty', 'refusal', 'copy', 'language', 'truncated'. Neighbours
  and limits decide 'truncated' first; only where they are silent do rules: no end mark, an abbreviation or a connecting
  word at the end, an open quotation or bracket.

What stands inside quotations counts neither as a refusal nor as another language. Where ``chunk_text`` is null, the
passage is read from ``input_text`` behind its last label. Defined cases: null and blank targets are 'empty'; null
inputs can't be copied; repeated rows of one key are one record (greatest values).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.sentences import MIDDLE, NUMBER_WORDS, TITLES, Model, fit, quotations, split
from folio.runtime import cut, read, ship, shuffle_parts

#: Words in less than this share of the texts are masked, in a finer and in a coarser form; at most (words a text) / share
#: words are kept and sent around.
FORM_SHARES = (0.03, 0.1)
SPIKE_SHARE, SPIKE_TIMES = 0.002, 6
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[一-鿿ぁ-ヺ]|[^\W\d_]+|[^\w\s]")
TRAIL = re.compile(r"(?:\s*(?:\.\.\.|…))?[\s,;:\[(（：，。–—-]*$")
NOTHING = set("none null nil nan na n/a nothing empty missing unknown keine kein nichts leer rien aucun aucune vide ninguno ninguna nada vacío vacio 无 無 空 没有 なし 特になし 該当なし start tbd undefined".split())
LABEL = re.compile(r"^\s*(?:\[[\w ]{1,24}\]|\(?[^\W\d_][\w ]{0,30}[:：]|#+ ?[\w ]{1,30}\n|\*\*[\w ]{1,30}\*\*:?)\s*")
INPUT_LABEL = re.compile(r"(?:^|\n)\s*(?:\[[\w ]{1,24}\]|[^\W\d_][\w ]{0,40}[:：](?=\s))\s*")
REFUSAL = re.compile(
    r"(?i)^(?:thank you[^.]{0,40}[,.]\s*(?:however,?|but)\s+|as an? (?:ai|assistant|language model)[^.,]{0,30},\s*|unfortunately,?\s+|i[’']m (?:very )?sorry[,.]?\s*(?:but )?|i am sorry[,.]?\s*(?:but )?|apologies\s*[–—,.-]?\s*|sorry[,.]?\s*(?:but )?|i regret[^.]{0,20}\s)*"
    r"(?:i (?:cannot|can ?not|can[’']t|won[’']t|will not|am unable|am not able|am not allowed|must decline|have to decline|refuse|do not feel able)|i[’']m (?:unable|not able|not allowed)|i[’']d rather not|i would rather not"
    r"|(?:this|that) is something i (?:must|have to|will) |summari[sz]ing [\w ]{1,40} goes beyond|my (?:instructions|guidelines|rules) (?:keep|prevent|stop|forbid)|there is no way for me|it is not possible for me)"
    r"|^(?:es tut mir (?:sehr )?leid[^.]{0,20}|leider|entschuldigung[^.]{0,20}|bedauerlicherweise)[,.]?\s*(?:aber )?(?:kann|darf|ist es mir|muss) [^.]{0,80}|^(?:ich kann|dabei kann ich|das kann ich)[^.]{0,60}(?:nicht|leider)"
    r"|^(?:désolée?[^.]{0,12}|malheureusement|je suis désolée?|je regrette)[,.]?\s*(?:mais )?(?:je|il)[^.]{0,30}(?:ne (?:peux|puis)|m[’']est impossible)|^(?:je ne peux pas|il m[’']est impossible)"
    r"|^(?:lo siento|lamentablemente|por desgracia|disculpe?)[,.]?\s*(?:pero )?no (?:puedo|me es posible|es posible|estoy)|^no (?:puedo (?:resumir|ayudar|continuar|hacer)|me es posible)"
    r"|^(?:很抱歉|抱歉|很遗憾|对不起|不好意思)[，,。]?\s*(?:但)?我?(?:无法|不能|不便)|^我(?:无法|不能)(?:总结|协助|帮助|回答|处理)|^(?:作为|身为)[^，。]{0,10}(?:助手|模型)[，,]"
    r"|^(?:大変)?申し訳(?:ありません|ございません)|^残念ながら|^[^。]{0,30}(?:お応え|要約|お手伝い)(?:は)?できません"
)
STOP = {
    "en": set("the of and to in is was that it for on with as at by from are were this which had has his her its not be an said then near between according".split()),
    "de": set("der die das und ist nicht war wird von mit auf für dem den des ein eine einen nach bei weil hat sich zu als im am wer wir gehen sagte fragte wurde kam fand laut gilt etwa wohnten".split()),
    "fr": set("le la les et est un une des du que qui dans pour pas sur au avec ce cette par plus selon soit environ vivaient pourquoi demanda répondit arriva trouva en de l d a".split()),
    "es": set("el la los las y es un una de del que en por con para no se su al lo como según dijo qué quién ha unas vivían preguntó llegó vio resulta más".split()),
}
CONNECTING = set(
    "the a an of by and or but because which was were that see for to with in on at from as if when while than of is are who whose und oder der die das dem den des von weil siehe mit für ein eine auf zu dass welche war "
    "le la les et ou de du des parce que qui voir avec pour un une dans sur dont el los las y o porque véase ver con por para un una en del al".split()
)
END_MARKS = tuple(".!?…。！？।")
CLOSERS = "”’\"'»“」』）)]›"


def squeeze(text: str | None) -> str:
    """Text without case, spacing, commas and other marks."""
    return "".join(filter(str.isalnum, (text or "").casefold()))


def same_text(source: str | None, forms: set[str]) -> bool:
    """Whether the squeezed source is one of the forms; the first letters tell most that aren't."""
    if not source:
        return False
    head = "".join(islice(filter(str.isalnum, source.casefold()), 24))
    return bool(head) and any(f.startswith(head) for f in forms) and squeeze(source) in forms


def unlabelled(text: str) -> str:
    return LABEL.sub("", text, count=1)


def is_empty(target: str | None) -> bool:
    if target is None:
        return True
    t = target.strip()
    words = re.sub(r"[\W_]+", " ", t.casefold()).strip()
    if not words:
        return True
    if re.sub(r"[^\w/]+", "", t.casefold()) in NOTHING or words in NOTHING or words.replace(" ", "") in ("na",):
        return True
    if LABEL.match(t) and not re.sub(r"[\W_]+", "", unlabelled(t)):
        return True
    rest = re.sub(r"[^\w/]+", "", unlabelled(t).casefold())
    return bool(LABEL.match(t)) and rest in NOTHING


def plain(text: str) -> str:
    """The text outside its quotations."""
    out, at = [], 0
    for a, b in quotations(text):
        out.append(text[at:a])
        at = b + 1
    out.append(text[at:])
    return " ".join(out)


def language(text: str | None, least: int = 2) -> str | None:
    """Main language, None if too little speaks for any."""
    if not text:
        return None
    latin = len(re.findall("[A-Za-zÀ-ÿ]", text))
    kana = han = deva = thai = 0
    if max(text) >= "\u0900":
        kana = len(re.findall("[ぁ-ヺ]", text))
        han = len(re.findall("[一-鿿]", text))
        deva = len(re.findall("[ऀ-ॿ]", text))
        thai = len(re.findall("[฀-๿]", text))
    best = max((3 * kana + (2 * han if kana > 0.15 * (kana + han) else 0), "ja"), (3 * han if kana <= 0.15 * (kana + han) else 0, "zh"), (deva, "hi"), (thai, "th"), (latin, "latin"))
    if best[0] < 4:
        return None
    if best[1] != "latin":
        return best[1]
    words = re.findall(r"[^\W\d_]+", text.lower())
    score = {k: sum(w in v for w in words) for k, v in STOP.items()}
    score["es"] += 2 * len(re.findall("[¿¡ñ]", text))
    score["de"] += 2 * len(re.findall("[ßäöü„]", text.lower())) + len(re.findall(r"\b(?:Nr|Abs|Mio)\.", text))
    score["fr"] += len(re.findall("[çêèœàù]", text.lower())) + len(re.findall(r"\b[ldnqcj]’", text.lower()))
    top = sorted(score.items(), key=lambda x: -x[1])
    if top[0][1] < least or top[0][1] == top[1][1]:
        return None
    return top[0][0]


def passage_of(input_text: str | None, chunk_text: str | None) -> str:
    """The passage: chunk_text, or what stands behind the last label of the input."""
    if chunk_text and chunk_text.strip():
        return chunk_text
    labels = list(INPUT_LABEL.finditer(input_text or ""))
    return (input_text or "")[labels[-1].end() :] if labels else (input_text or "")


def cut_off(target: str) -> bool | None:
    """Whether the last sentence is certainly incomplete (True), complete (False), or unclear (None)."""
    t = target.rstrip()
    opened = set()
    for a, b in quotations(t):
        opened |= {a, b}
    spans = quotations(t)
    german = "„" in t
    for i, c in enumerate(t):
        if c in "“„«「『‘" and i not in opened and not any(a < i < b for a, b in spans) and not (c == "“" and german):
            if c == "‘" and i and t[i - 1].isalnum():
                continue
            return True
    for o, c in ("()", "[]", "（）"):
        if t.rfind(o) > t.rfind(c):
            return True
    body = t.rstrip(CLOSERS + "   ")
    if not body or body[-1] not in ".!?…。！？।":
        return True
    dots = re.search(r"(\s*)(?:\.\.\.|…)$", body)
    core = body[: dots.start()] if dots else body[:-1]
    words = core.split()
    last = words[-1].strip("“„«‘(\"'").lower() if words else ""
    if dots:
        if dots.group().strip() == "..." and dots.group(1):
            return True
        if last.strip("“") in CONNECTING or core[-1:] in ",;:(（[，、：的和因":
            return True
        return None
    if body[-1] == ".":
        raw = words[-1] if words else ""
        if last in TITLES or last in NUMBER_WORDS - {"km"} or last in MIDDLE - {"al", "ex"}:
            return True
        if re.fullmatch(r"[A-Z]", raw) or re.fullmatch(r"(?:[A-Z]\.)+[A-Z]", raw):
            return True
    return bool(re.search(r"(?:^|[.!?…»]\s+)—[¿¡][^—?!]*[?!]$", t))  # Spanish dialogue without its speaker


def ends_well(target: str) -> bool:
    """Whether the text ends in an end mark that is no ellipsis."""
    body = target.rstrip().rstrip(CLOSERS + "   ")
    return bool(body) and body[-1] in ".!?。！？।" and not body.endswith("...")


def defect(target: str | None, input_text: str | None, previous: str | None, chunk: str | None, shortened: bool, at_limit: bool, whole: bool = False, astray: bool = False) -> str | None:
    """The pair's defect, or None. shortened, astray, whole: what the neighbours say; at_limit: ends at a length limit."""
    if is_empty(target):
        return "empty"
    stripped = unlabelled(target)
    for text in (target, stripped):
        if REFUSAL.match(text.strip()):
            return "refusal"
    passage = passage_of(input_text, chunk)
    forms = {squeeze(target), squeeze(stripped)} - {""}
    for source in (input_text, chunk, passage, previous):
        if same_text(source, forms) or (source and same_text(unlabelled(source), forms)):
            return "copy"
    own, theirs = (language(plain(t), 1) or language(t) for t in (stripped, passage))
    if own and theirs and own != theirs:
        return "language"
    if whole:
        return None
    if shortened or ((astray or at_limit) and not ends_well(target)):
        return "truncated"
    return "truncated" if cut_off(target) else None


def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts sorted by (t, probe) in. Out: 'row', a probe that is a proper prefix of a text; 'open', a probe that may still
    be one of a text in a later partition; 'first', the partition's first text. Probes with a common prefix stand before
    every text that begins with them, so only a chain of nested probes waits for the next text."""
    part, first, chain = TaskContext.get().partitionId(), None, []
    for pdf in batches:
        hits = []
        for t, probe in zip(pdf["t"], pdf["probe"]):
            chain = [c for c in chain if t.startswith(c)]
            if probe:
                chain.append(t)
                continue
            if first is None:
                first = t
            hits += [c for c in chain if len(c) < len(t)]
            chain = []
        if hits:
            yield pd.DataFrame({"part": part, "kind": "row", "t": hits})
    rows = [(part, "open", c) for c in chain] + ([(part, "first", first)] if first is not None else [])
    if rows:
        yield pd.DataFrame(rows, columns=["part", "kind", "t"])


def prefixes_of(probes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those distinct probes (column t) that are proper prefixes of one of the texts (column t)."""
    n = shuffle_parts(texts.sparkSession)
    both = texts.select("t", F.lit(False).alias("probe")).unionByName(probes.select("t", F.lit(True).alias("probe"))).distinct()
    done = cut(both.repartitionByRange(n, "t").sortWithinPartitions("t", "probe").mapInPandas(_prefixes, "part int, kind string, t string"))
    firsts = done.where("kind = 'first'").select("part", F.col("t").alias("first"))  # a row a partition
    following = firsts.select("part", "first").unionByName(done.where("kind = 'open'").select("part", F.lit(None).cast("string").alias("first")).distinct())
    following = following.groupBy("part").agg(F.max("first").alias("first"))
    behind = F.first("first", ignorenulls=True).over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing))
    ahead = following.select("part", behind.alias("next")).where("next is not null")
    late = done.where("kind = 'open'").join(F.broadcast(ahead), "part").where("startswith(next, t) and length(next) > length(t)")
    return done.where("kind = 'row'").select("t").unionByName(late.select("t")).distinct()


def shortened_texts(texts: DataFrame) -> DataFrame:
    """Those distinct texts (column t) that are proper prefixes of another one."""
    return prefixes_of(texts, texts)


class Masks(dict):
    """What a token becomes: itself if it is kept, else a sign of its kind."""

    def __init__(self, kept: frozenset):
        super().__init__()
        self.kept = kept

    def __missing__(self, w: str) -> str:
        out = "0" if w[0].isdigit() else w if w in self.kept else "A" if w[0].isupper() else "a" if w[0].islower() else "_"
        if len(self) < 500_000:
            self[w] = out
        return out


def form(tokens: list[str], masks: Masks) -> list[str]:
    """Tokens with figures and rare words masked; masked words keep their case, runs of masked signs are one."""
    out = [masks[w] for w in tokens]
    return [w for w, before in zip(out, ["", *out]) if w != "_" or before != "_"] if "_" in out else out


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many texts of the batch each word stands."""
    for pdf in batches:
        n: Counter = Counter()
        for col in ("target_text", "chunk_text"):
            for t in pdf[col]:
                if t:
                    n.update(set(TOKEN.findall(t)))
        yield pd.DataFrame({"word": list(n), "n": list(n.values())})


def frequent_words(pairs: DataFrame, shares: tuple[float, ...] = FORM_SHARES) -> list[frozenset]:
    """Words in at least each share of all texts: never more than the words of an average text divided by the share."""
    texts = pairs.agg(F.count(F.nullif("target_text", F.lit(""))) + F.count(F.nullif("chunk_text", F.lit("")))).first()[0]
    n = pairs.select("target_text", "chunk_text").mapInPandas(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = n.where(F.col("n") >= min(shares) * texts).collect()
    return [frozenset(r["word"] for r in rows if r["n"] >= share * texts) for share in shares]


def _last(text: str, model: Model) -> tuple[list[str], str]:
    """The sentences of a text but the last, and the last one."""
    spans = [x for block in re.finditer(r"[^\n]+", text) for x in ((block.start() + a, block.start() + b) for a, b in split(block.group(), False, model))]
    parts = [text[a:b] for a, b in spans]
    return parts[:-1], (parts[-1] if parts else text.strip())


FORMS = "pair_id long, kind string, t string"


def _forms(levels: list[frozenset], model: Model):
    """'whole': forms of whole sentences, at each level of masking. 'own': the last sentence of a target, at each level;
    'cut0' to 'cut3': its finest form without what trails and the last 0 to 3 tokens. A form begins with its level."""
    line = lambda tokens, level=0: f"{level} " + "".join(w + " " for w in tokens)
    masks = [Masks(kept) for kept in levels]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, seen = [], set()
            for pid, target, chunk in zip(pdf["pair_id"], pdf["target_text"], pdf["chunk_text"]):
                wholes: list[str] = []
                if chunk:
                    wholes, last = _last(chunk, model)
                    if ends_well(last):
                        wholes = [*wholes, last]
                if target and target.strip():
                    more, tail = _last(target, model)
                    wholes = [*wholes, *more]
                    marked = tail.rstrip(CLOSERS + " ")[-1:] in END_MARKS  # without any mark a coarse likeness says nothing
                    rows += [(pid, "own", line(form(TOKEN.findall(tail), m), i)) for i, m in enumerate(masks if marked else masks[:1])]
                    bare = form(TOKEN.findall(TRAIL.sub("", tail)), masks[0])
                    rows += [(pid, f"cut{k}", line(bare[: len(bare) - k])) for k in range(4) if len(bare) - k >= max(1, 2 * k)]
                for tokens in map(TOKEN.findall, wholes):
                    if tokens:
                        seen |= {line(form(tokens, m), i) for i, m in enumerate(masks)}
            rows += [(None, "whole", t) for t in seen]
            out = pd.DataFrame(rows, columns=["pair_id", "kind", "t"])
            yield out.astype({"pair_id": "Int64"})

    return run


def neighbours(pairs: DataFrame) -> DataFrame:
    """pair_id, whole, shortened, astray: what the sorted forms say of each target's last sentence. A form is a whole
    sentence's if it stands as one apart from the targets' ends; a target's own end is no witness for another one."""
    levels, model = frequent_words(pairs), fit([])
    forms = cut(pairs.select("pair_id", "target_text", "chunk_text").mapInPandas(_forms(levels, model), FORMS))
    wholes = cut(forms.where("kind = 'whole'").select("t").distinct())
    ends = forms.where("kind <> 'whole'")
    stands = wholes.withColumn("stands", F.lit(True))
    goes_on = prefixes_of(ends.where("kind <> 'own'").select("t").distinct(), wholes).withColumn("goes_on", F.lit(True))
    seen = ends.join(stands, "t", "left").join(goes_on, "t", "left")
    is_ = lambda k, c: F.coalesce(F.max(F.when(F.col("kind") == k, F.col(c))), F.lit(False))
    said = seen.groupBy("pair_id").agg(is_("own", "stands").alias("whole"), is_("cut0", "goes_on").alias("on0"), is_("cut1", "goes_on").alias("on1"), (is_("cut2", "goes_on") | is_("cut3", "goes_on")).alias("on2"))
    return said.select("pair_id", "whole", F.col("on0").alias("shortened"), (F.col("on1") | F.col("on2")).alias("astray"))


def limits(lengths: DataFrame) -> DataFrame:
    """Lengths (column n) at which far more texts end than at the ten lengths around, by shares of all texts."""
    count = lengths.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    whole = count.agg(F.sum("k").alias("all"))
    around = count.select(F.explode(F.sequence(F.col("n") - 5, F.col("n") + 5)).alias("m"), "n", "k").where("m <> n").groupBy(F.col("m").alias("n")).agg(F.sum("k").alias("near"))
    wide = count.join(around, "n", "left").crossJoin(F.broadcast(whole))  # one row
    return wide.where((F.col("k") > F.lit(SPIKE_SHARE) * F.col("all")) & (F.col("k") * 10 >= SPIKE_TIMES * (F.coalesce("near", F.lit(0)) + 10))).select("n")


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [defect(r.target_text, r.input_text, r.previous_summary, r.chunk_text, bool(r.shortened), bool(r.at_limit), bool(r.whole), bool(r.astray)) for r in pdf.itertuples(index=False)]
        keep = np.array([x is not None for x in out], bool)
        yield pd.DataFrame({"pair_id": pdf["pair_id"].to_numpy()[keep], "defect": [x for x in out if x is not None]})


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id and defect of every defective pair."""
    ship(pairs.sparkSession)
    cols = ("target_text", "input_text", "previous_summary", "chunk_text")
    one = cut(pairs.where("pair_id is not null").groupBy("pair_id").agg(*[F.max(c).alias(c) for c in cols]))
    one = one.withColumn("n", F.length("target_text"))
    spikes = limits(one.where("n > 0").select("n")).withColumn("at_limit", F.lit(True))
    flags = ["whole", "shortened", "astray", "at_limit"]
    wide = one.join(neighbours(one), "pair_id", "left").join(F.broadcast(spikes), "n", "left").fillna(False, flags)  # fewer than 1 / SPIKE_SHARE limits
    return wide.select("pair_id", *cols, *flags).mapInPandas(_judged, "pair_id long, defect string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair whose target is no proper updated summary, with its defect."""
    return defective_pairs(read(spark, sf_dir, "stage2_pair", "pair_id", "input_text", "target_text", "previous_summary", "chunk_text"))
