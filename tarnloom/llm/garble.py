"""Problem 3: text that was read with a wrong character encoding.

Twins are joined on text stripped of its non-ASCII characters.  The unit of the
join is the token, since a token ("caf" of ``cafÃ©``) has far more clean twins
than a whole caption.  The characters of a token are aligned with those of its twin,
the most frequent token of the same ASCII letters in the same places: what stands
between two ASCII letters in the one stands for what stands there in the other.  A
correspondence (``Ã©`` for ``é``) that several different words show, and that
explains most words that hold it, is learned and applied to all records, twins or
none.  So any encoding can be found, one that nobody has heard of too.

Lists of known encodings are a prior: one that enough twins confirm extends the
mapping to letters for which no twin is at hand, and to words without ASCII letters.

Two families are told apart.  UTF-8 bytes read as a one-byte encoding leave
sequences of two or more characters, which identify themselves once the
transformation is learned.  One one-byte encoding read as another changes single
letters, so there a token counts only if its restored form is a common token, a
quotation or a lone dash.  U+FFFD is always garbled; it is restored where one clean token
fits its pattern best.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tarnloom.llm.norm import INVISIBLE, LOOK_ALIKE
from tarnloom.plans.lineage import cut

#: Encodings as which UTF-8 is read by mistake (fixed values).
UTF8_READ_AS = ["cp1252", "latin_1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "cp1253", "cp1254", "cp1257", "koi8_r", "cp866"]
OTHER_SCRIPT = {"cp1251", "cp1253", "koi8_r", "cp866"}
#: A letter in at least this share of the words of one script is native to it.
NATIVE_SHARE = 0.02
#: (encoding of the bytes, encoding as which they are read) (fixed values).
ONE_BYTE = [("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"),
            ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251")]
#: Distinct tokens with a clean twin that make a transformation a learned one.
LEAST_TWINS = 2
#: A clean twin of a one-byte transformation is at least so many times as frequent.
TIMES_COMMON = 3
#: Letters of a clean twin of a token without ASCII characters.
LEAST_LETTERS = 4
#: Different words that show correspondences of one kind outside the prior, and the share
#: that each must explain of all words which hold it: if it shortens the text, and if not.
LEAST_WORDS, LEAST_SHARE, LEAST_SHARE_EVEN = 3, 0.5, 0.8
#: Longest garbled sequence that stands for one or two characters.
UNIT = 8
LOST = "�"

NOT_ASCII = r"[^\x00-\x7F]"
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_QUOTES = {"“": "”", "‘": "’", "«": "»", "„": "“"}


def _read(raw: bytes, encoding: str) -> str:
    """Undefined bytes become the control character of their number."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _natural(unit: str, native: set[str]) -> bool:
    """Only letters that words of their script are written with: no sign of damage."""
    return all(c.isalpha() and c in native for c in unit)


def unit_table(alphabet: dict[str, int], native: set[str] = frozenset(), joint: bool = False) -> dict[str, dict[str, str]]:
    """Per transformation, what each character of the alphabet turns into,
    mapped back.  ``|lower``: the garbled text was put in lower case later; of
    Cyrillic and Greek pages only with a sign in it, since their small letters
    also stand for Latin ones.  Sequences that lower case does not change are
    there only if ``joint``: they are no sign of lower case, but occur with it."""
    out: dict[str, dict[str, str]] = {}
    common = sorted(alphabet, key=lambda c: (-alphabet[c], c))
    for enc in UTF8_READ_AS:
        plain, low = {}, {}
        for x in common:
            if x == LOST:
                continue
            unit = _read(x.encode(), enc)
            if not _natural(unit, native):
                plain.setdefault(unit, x)
            small = unit.lower()
            if (joint or small != unit) and not (enc in OTHER_SCRIPT and small.isalpha()):
                low.setdefault(small, x)
        out[f"utf8>{enc}"] = plain
        out[f"utf8>{enc}|lower"] = {u: x for u, x in low.items() if joint or u not in plain}
    for true, read in ONE_BYTE:
        table = {}
        for x in common:
            try:
                unit = x.encode(true).decode(read)
            except UnicodeError:
                continue
            if unit != x and ord(unit) > 127:
                table.setdefault(unit, x)
        out[f"{true}>{read}"] = table
    return out


#: Learned by alignment alone.
ALIGNED = "aligned"


def many(name: str) -> bool:
    return name.startswith("utf8>") or name == ALIGNED


class Decoder:
    """Replaces the units of one or more tables, the longest first."""

    def __init__(self, *tables: dict[str, str]) -> None:
        self.map: dict[str, str] = {}
        for t in tables:
            for u, x in t.items():
                self.map.setdefault(u, x)
        self.lengths = sorted({len(u) for u in self.map}, reverse=True)
        self.leads = re.compile("[" + "".join(map(re.escape, sorted({u[0] for u in self.map}))) + "]") if self.map else None

    def once(self, text: str) -> tuple[str, int]:
        """The text with its units replaced, and how many there were."""
        if self.leads is None:
            return text, 0
        out, at, hits, m = [], 0, 0, self.leads.search(text)
        while m:
            i = m.start()
            for n in self.lengths:
                x = self.map.get(text[i : i + n])
                if x is not None and i + n <= len(text):
                    out += (text[at:i], x)
                    at, hits = i + n, hits + 1
                    break
            m = self.leads.search(text, max(at, i + 1))
        out.append(text[at:])
        return "".join(out), hits

    def fully(self, text: str) -> str:
        """Undone until nothing is seen; for units longer than what replaces them, so
        that the text shrinks each time."""
        hits = 1
        while hits:
            text, hits = self.once(text)
        return text


def _tokens(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda t: t.rlike(NOT_ASCII))


def _skeleton(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, NOT_ASCII, ""))


def _native_letters(tokens: DataFrame) -> set[str]:
    """The Cyrillic and Greek letters that distinct words of their script are
    regularly written with."""
    out: set[str] = set()
    for script in ("IsCyrillic", "IsGreek"):
        words = tokens.where(F.col("token").rlike(rf"^\p{{{script}}}+$"))
        seen = words.select(F.explode(F.array_distinct(F.split("token", ""))).alias("c")).groupBy("c").count().collect()
        n = words.count()
        out |= {r["c"] for r in seen if r["c"] and r["count"] >= max(1, NATIVE_SHARE * n)}
    return out


_RUN, _RUN_AND_NEXT = re.compile(r"[^\x00-\x7f]+"), re.compile(r"[^\x00-\x7f]+[\x00-\x7f]?")


def _seen(t: str) -> str:
    """The display form of a few characters."""
    plain = unicodedata.normalize("NFC", t).translate({**{ord(k): v for k, v in LOOK_ALIKE.items()}, **dict.fromkeys(INVISIBLE)})
    return unicodedata.normalize("NFC", plain)


def _plausible(unit: str, back: str) -> bool:
    """Not a matter of spelling: letter case, width, accents, invisible characters, or
    one sign of punctuation for another."""
    if LOST in unit + back or not 0 < len(back) <= 2 or len(unit) > UNIT:
        return False
    bare = "".join(c for c in unit if unicodedata.category(c) not in ("Mn", "Me", "Cf", "Zs"))
    fold = lambda t: unicodedata.normalize("NFKC", t).casefold()
    base = lambda t: [unicodedata.normalize("NFD", c)[0].casefold() for c in t]
    if not bare or _seen(unit) == _seen(back) or fold(bare) == fold(back) or base(bare) == base(back):
        return False
    return any(unicodedata.category(c)[0] not in "PZ" for c in unit) or len(unit) > len(back)


def _kind(unit: str, back: str) -> str:
    """What correspondences of one encoding have in common: their lengths, and the two
    scripts, or within one script the character they begin with."""
    script = lambda c: unicodedata.name(c, "").split(" ")[0]
    a, b = script(unit[0]), script(back[0])
    return f"{len(unit)} {len(back)} {unit[0] if a in (b, '') else a + ' ' + b}"


def aligned(garbled: str, clean: str, swallowed: bool = False) -> list[tuple[str, str]]:
    """What the characters of a token correspond to in its twin.  ``swallowed``: the
    garbled characters hold the ASCII letter after them too, as two-byte encodings
    leave them.  Nothing if the two have not the same places for them."""
    ours, theirs = _RUN.findall(garbled), (_RUN_AND_NEXT if swallowed else _RUN).findall(clean)
    if len(ours) != len(theirs):
        return []
    out = []
    for u, x in zip(ours, theirs):
        k = len(u) // len(x)
        if k * len(x) == len(u) and not swallowed:  # a sequence of one length a character
            out += [(u[i * k : (i + 1) * k], c) for i, c in enumerate(x)]
        else:
            out.append((u, x))
    return [(u, x) for u, x in out if u != x and _plausible(u, x)]


def _correspondences(tokens: DataFrame) -> dict[str, tuple[str, float]]:
    """``{unit: (original, share)}`` learned by aligning every token with the most
    frequent one of its shape (its ASCII letters, and where others stand between
    them): one twin a token, never all pairs of a shape.  Shapes of fewer than two ASCII
    letters say nothing.  Only what is learned, an alphabet, comes to the driver."""
    shape = lambda run: F.lower(F.regexp_replace("token", run, "\x01"))
    worded = tokens.withColumn("shape", shape(r"[^\x00-\x7F]+")).where(F.col("shape").rlike("[0-9a-z].*[0-9a-z]"))
    top = worded.groupBy("shape").agg(F.max_by(F.struct("token", "n"), F.struct("n", "token")).alias("t")).select("shape", F.col("t.token").alias("clean"), F.col("t.n").alias("clean_n"))
    more = top.withColumn("token", F.col("clean")).select(shape(r"[^\x00-\x7F]+[\x00-\x7F]?").alias("more"), "clean", "clean_n")
    more = more.groupBy("more").agg(F.max_by(F.struct("clean", "clean_n"), F.struct("clean_n", "clean")).alias("t")).select(F.col("more").alias("shape"), "t.*", F.lit(True).alias("swallowed"))
    twins = worded.join(top.withColumn("swallowed", F.lit(False)).unionByName(more), "shape").where("token <> clean AND clean_n >= n")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for g, c, s, often, w in zip(*(b[i].to_pylist() for i in ("token", "clean", "swallowed", "often", "shape"))):
                rows += [(_kind(u, x), u, x, w) for u, x in aligned(g, c, s) if often or len(u) > len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], names=["kind", "unit", "back", "shape"])

    often = (F.col("clean_n") >= TIMES_COMMON * F.col("n")).alias("often")
    seen = twins.select("token", "clean", "swallowed", often, "shape").mapInArrow(pairs, "kind string, unit string, back string, shape string")
    votes = seen.groupBy("kind", "unit", "back").agg(F.countDistinct("shape").alias("words"))
    best = votes.groupBy("unit").agg(F.max_by(F.struct("kind", "back", "words"), F.struct("words", "back")).alias("b")).select("unit", "b.*")
    best = cut(best, "units")
    kinds = best.groupBy("kind").agg(F.sum("words").alias("all")).where(F.col("all") >= LEAST_WORDS)
    best = best.join(kinds, "kind", "left_semi")

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [u for t in b["token"].to_pylist() for u in {r[i : i + n] for r in _RUN.findall(t) for i in range(len(r)) for n in range(1, min(UNIT, len(r) - i) + 1)}]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["unit"])

    held = tokens.select("token").mapInArrow(substrings, "unit string").join(best.select("unit"), "unit", "left_semi").groupBy("unit").agg(F.count("*").alias("tokens"))
    share = F.least(F.lit(1.0), F.col("words") / F.col("tokens"))
    enough = share >= F.when(F.length("unit") > F.length("back"), LEAST_SHARE).otherwise(LEAST_SHARE_EVEN)
    return {r["unit"]: (r["back"], r["share"]) for r in best.join(held, "unit").withColumn("share", share).where(enough).collect()}


def _twin_candidates(tokens: DataFrame, tables: dict[str, dict[str, str]]) -> DataFrame:
    """``(token, n, how, restored)``: what each token would be if a given
    transformation had made it."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoders = {how: Decoder(t) for how, t in tables.items()}
        for b in batches:
            rows = []
            for token, n in zip(b["token"].to_pylist(), b["n"].to_pylist()):
                for how, d in decoders.items():
                    back = d.fully(token) if many(how) else d.once(token)[0]
                    if back != token:
                        rows.append((token, n, how, back))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], names=["token", "n", "how", "restored"])

    return tokens.select("token", "n").mapInArrow(propose, "token string, n long, how string, restored string")


def learn(df: DataFrame, column: str = "text") -> tuple[dict[str, dict[str, str]], dict[str, dict[str, str]], dict[str, str], DataFrame, DataFrame]:
    """What the twins of ``df[column]`` teach: the tables by which the learned
    transformations are told, those by which they are undone (with natural letters
    too), what else single characters stand for, the confirmed tokens ``(token, how)``
    of one-byte transformations, and all distinct tokens with a non-ASCII character
    ``(token, n)``.

    The alphabet and the list of transformations are bounded by Unicode and come
    to the driver; tokens stay distributed."""
    odd = df.where(F.col(column).rlike(NOT_ASCII)).select(F.col(column).alias("text"))
    chars = odd.select(F.explode(F.regexp_extract_all("text", F.lit(NOT_ASCII), F.lit(0))).alias("c")).groupBy("c").count()
    tokens = cut(odd.select(F.explode(_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")), "tokens")
    alphabet = {r["c"]: r["count"] for r in chars.collect()}
    native = _native_letters(tokens)
    tables = unit_table(alphabet, native)
    tokens_over = tokens.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # one small file otherwise
    units = _correspondences(tokens_over)
    maybe = cut(_twin_candidates(tokens_over, tables), "maybe")
    key = _skeleton(F.col("token"))
    # a clean twin has the same skeleton and is what the token is restored to; it is
    # itself no garble that a longer sequence explains
    decodable = maybe.where(F.col("how").startswith("utf8>")).select("token").distinct()
    clean = tokens.join(decodable, "token", "left_anti").select(F.col("token").alias("restored"), F.col("n").alias("clean_n"), key.alias("skeleton"))
    # a word without an ASCII letter (Cyrillic, Greek) has an empty skeleton: there the
    # restored form is evidence enough if it has several letters
    word = F.length("skeleton") == 0
    enough = ~word | F.col("restored").rlike(rf"^\p{{L}}{{{LEAST_LETTERS},}}$")
    twins = maybe.withColumn("skeleton", key).where(enough).join(clean, ["skeleton", "restored"])
    sure = twins.where(F.col("how").startswith("utf8>") | (F.col("clean_n") >= TIMES_COMMON * F.col("n")))
    sure = cut(sure.select("token", "how", F.when(word, F.length("restored")).otherwise(F.length("skeleton")).alias("width")), "twins")
    votes = sure.where(F.col("width") >= 2).groupBy("how").agg(F.count("*").alias("n")).collect()
    names = {r["how"] for r in votes if r["n"] >= LEAST_TWINS}
    known = {how: t for how, t in unit_table(alphabet, native, joint=True).items() if how in names}
    one_byte = [h for h in known if not many(h)]
    quoted = maybe.where(F.col("how").isin(one_byte) & F.col("restored").rlike(r"^[“‘«„][0-9A-Za-z]+[”’»“]$") & F.col("token").rlike(r"^\p{L}.*\p{L}$"))
    dash = maybe.where(F.col("how").isin(one_byte) & F.col("restored").isin("–", "—") & F.col("token").rlike(r"^\p{L}$"))
    confirmed = sure.where(F.col("how").isin(one_byte)).select("token", "how").union(quoted.select("token", "how")).union(dash.select("token", "how")).distinct()
    whole = {how: t for how, t in unit_table(alphabet, joint=True).items() if how in names}
    prior = Decoder(*known.values())  # what it sees in part is not outside it
    outside = {u: x for u, x in units.items() if not prior.once(u)[1]}
    shrinking = {u: x for u, (x, _) in outside.items() if len(u) > len(x)}
    if shrinking:
        known[ALIGNED] = whole[ALIGNED] = shrinking
    even = {u: x for u, (x, _) in outside.items() if len(u) <= len(x)}
    return known, whole, even, confirmed, tokens


def _apply(known: dict[str, dict[str, str]], whole: dict[str, dict[str, str]], even: dict[str, str] | None = None):
    """Restores texts round by round: the transformation of which most is seen is
    undone, until nothing more is seen; then what ``even`` says, once."""
    order = [f"utf8>{e}{low}" for low in ("", "|lower") for e in UTF8_READ_AS if f"utf8>{e}{low}" in known]
    order += [ALIGNED] if ALIGNED in known else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_of = Decoder(*(known[how] for how in order))
        last = Decoder(even or {})
        see, undo = [Decoder(known[how]) for how in order], [Decoder(whole[how]) for how in order]

        def restored(text: str) -> str:
            while any_of.once(text)[1]:  # each round replaces units by less: it ends
                hits = [d.once(text)[1] for d in see]
                text = undo[hits.index(max(hits))].once(text)[0]
            return last.once(text)[0]

        for b in batches:
            back = [restored(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["text"], pa.array(back, pa.string())], names=["id", "text", "restored"])

    return run


def _by_confirmed(odd: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``(id, how)`` of the records that hold a confirmed token."""
    held = odd.select("id", F.explode(F.array_distinct(_tokens(F.col("text")))).alias("token"))
    return held.join(confirmed, "token").groupBy("id").agg(F.min("how").alias("how"))


def repair(df: DataFrame, key: str = "pos", column: str = "text") -> DataFrame:
    """``(key, garbled, restored)``: the records of ``df`` whose ``column`` is
    garbled, wholly or in part, with the text restored where that can be had,
    else null.  Null and ASCII texts are never garbled; ``key`` must be unique."""
    src = df.select(F.col(key).alias("id"), F.col(column).alias("text"))
    odd = cut(src.where(F.col("text").rlike(NOT_ASCII) & F.col("id").isNotNull()), "odd")
    known, whole, even, confirmed, tokens = learn(odd)
    id_type = odd.schema["id"].dataType.simpleString()
    decoded = cut(odd.mapInArrow(_apply(known, whole, even), f"id {id_type}, text string, restored string"), "decoded")
    singles = {h: t for h, t in known.items() if not many(h)}
    out = decoded
    if singles:
        how = _by_confirmed(odd, confirmed)
        one = F.col("restored")
        for h, t in sorted(singles.items()):
            one = F.when(F.col("how") == h, F.translate("restored", "".join(t), "".join(t.values()))).otherwise(one)
        out = decoded.join(how, "id", "left").withColumn("restored", one)
    # lost characters: the most frequent clean token of the same pattern
    lost_in = out.where(F.col("text").contains(LOST))
    mask = F.regexp_replace("token", NOT_ASCII, LOST)
    pattern = tokens.where(~F.col("token").contains(LOST)).select(mask.alias("mask"), "token", "n")
    wanted = lost_in.select("id", F.posexplode(F.split("restored", f"(?={TOKEN})(?<!{TOKEN[:-1]})|(?<={TOKEN[:-1]})(?!{TOKEN[:-1]})")).alias("at", "mask"))
    asked = wanted.where(F.col("mask").contains(LOST)).select("mask").distinct()
    best = pattern.join(asked, "mask", "left_semi").groupBy("mask").agg(F.max_by("token", F.struct("n", "token")).alias("token"))
    filled = wanted.join(best, "mask", "left").select("id", F.struct("at", F.coalesce("token", "mask").alias("t")).alias("p"))
    filled = filled.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "").alias("filled"))
    out = out.join(filled, "id", "left").withColumn("restored", F.coalesce("filled", "restored"))
    bad = out.where((F.col("restored") != F.col("text")) | F.col("text").contains(LOST))
    whole = F.when(~F.col("restored").contains(LOST), F.col("restored"))
    return bad.select(F.col("id").alias(key), F.col("text").alias("garbled"), whole.alias("restored"))


def garbled_rows(manifest: DataFrame) -> DataFrame:
    """``(pos)``: the captions that hold garbled text."""
    return repair(manifest).select("pos")
