"""Operators of an audit, each DataFrame to DataFrame.

Keys: ``audit`` names an answer, ``pkg`` the evidence it was written from, ``seg`` and ``tok`` count segments of an
answer and tokens of a segment, ``item`` counts the items of a package. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import folded, form_places_function, segment_function
from ..functions.matching import DIGIT_CHAINS, DIGIT_RUNS, OTHER_RUNS, PAIRS, PIECES, SOURCE_LIMIT
from ..runtime import alike, by_key, stored

NEARBY = 5
#: A package's forms up to this number go to each of its items; more forms than that meet items by their words.
FEW = 64
# Verdicts, those that are findings and those that say a segment wasn't looked at, and the form of a placeholder.
FINDINGS = ("floating", "contradicted")
VERDICTS = ("grounded", "floating", "contradicted", "unbearing", "unchecked", "unverifiable")
UNEXAMINED = ("unchecked", "unverifiable")
RESIDUE = r"[<\[{][A-Z][A-Z0-9_]{0,62}_[0-9]{1,6}[>\]}]"


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open spans share a character; an empty span shares none."""
    return (a_start < b_end) & (b_start < a_end) & (a_start < a_end) & (b_start < b_end)


def within(inner_start: Column, inner_end: Column, start: Column, end: Column) -> Column:
    return (start <= inner_start) & (inner_end <= end)


def find_spans(text: Column, pattern: str) -> Column:
    """array<struct<token,start,end>> of whole matches, by lengths of what lies between them."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    at = F.transform(
        F.sequence(F.lit(1), F.size(found)),
        lambda k: F.aggregate(F.slice(between, F.lit(1), k), F.lit(0), lambda n, x: n + F.length(x))
        + F.aggregate(F.slice(found, F.lit(1), k - 1), F.lit(0), lambda n, x: n + F.length(x)),
    )
    spans = F.zip_with(
        found, at, lambda t, s: F.struct(t.alias("token"), s.alias("start"), (s + F.length(t)).alias("end"))
    )
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast("array<struct<token:string,start:int,end:int>>"))


def placeholders(text: Column) -> Column:
    """Tokens that a redactor leaves: a bracket, upper-case words, a number, a bracket."""
    return find_spans(text, RESIDUE)


def oversized_runs(text: Column, limit: int = 256) -> Column:
    """Lengths of digit runs that are too long for any rule."""
    runs = F.regexp_extract_all(text, F.lit("[0-9０-９](?:[0-9０-９.,]*[0-9０-９])?"), F.lit(0))
    return F.filter(F.transform(runs, lambda r: F.length(r)), lambda n: n > limit)


def segments(texts: DataFrame, text: str, codes=None, tokens: str = "all") -> DataFrame:
    """``texts`` with one row for each segment of ``text``: seg, start, end, body, kind, script, boundary, tokens."""
    cut = segment_function(codes, tokens).asNondeterministic()
    keys = [c for c in texts.columns if c != text]
    rows = texts.withColumn("__cut", cut(F.col(text))).select(*keys, F.explode("__cut").alias("s"))
    return rows.select(
        *keys, F.col("s.ord").alias("seg"), "s.start", "s.end", F.col("s.text").alias("body"), "s.kind", "s.script", "s.boundary", "s.tokens"
    )


def tokens_of(segs: DataFrame) -> DataFrame:
    """One row for each token of segments that may be examined."""
    rows = segs.where(F.col("kind") != "code").select("audit", "pkg", "seg", F.explode("tokens").alias("t"))
    return rows.select("audit", "pkg", "seg", F.col("t.ord").alias("tok"), "t.kind", "t.start", "t.end", "t.text", "t.form", "t.probe", "t.digits", "t.shape", "t.keys")


def source_index(items: DataFrame, codes=None) -> DataFrame:
    """Tokens of the evidence with their sentences: pkg, item, entry, kind, text, start, end, digits, shape, s_start, s_end."""
    segs = segments(items.select("pkg", "item", "item_id", "document_id", "source_path", "section", F.col("start").alias("base"), "text"), "text", codes)
    keys = ["pkg", "item", "item_id", "document_id", "source_path", "section", "base"]
    rows = segs.where(F.col("kind") != "code").select(*keys, F.col("start").alias("s_start"), F.col("end").alias("s_end"), "seg", F.explode("tokens").alias("t"))
    return rows.select(
        *keys, "s_start", "s_end", (F.col("seg").cast("long") * 1_000_000 + F.col("t.ord")).alias("entry"),
        "t.kind", "t.text", "t.start", "t.end", "t.digits", "t.shape",
    )


def _candidates(forms: DataFrame, items: DataFrame) -> DataFrame:
    """(pkg, form, item): items that may hold a form, by an equi-join on the words that ``keys_of`` gives it.

    An item lists the words of those sorts only that some form of its package asks for. The few forms without any word, as
    one Han character, meet the items of their package that hold their longest run as a literal.
    """
    digits, bare = F.get("keys", F.lit(0)).rlike("^[0-9]"), F.size("keys") == 0
    asked = forms.groupBy("pkg").agg(F.bool_or(digits).alias("digits"), F.bool_or(~digits & ~bare).alias("words"), F.bool_or(bare).alias("bare"))
    none = F.array().cast("array<string>")
    held = by_key(items.select("pkg", "item", "text"), asked, "pkg").withColumn("fold", folded(F.col("text")))
    runs = lambda pattern, group=0: F.regexp_extract_all("fold", F.lit(pattern), F.lit(group))
    chains = [F.transform(runs(pattern, 1), lambda x: F.regexp_replace(x, r"\s+", "")) for pattern in DIGIT_CHAINS]
    words = F.concat(
        F.when(F.col("digits"), F.concat(runs(DIGIT_RUNS), *chains)).otherwise(none), F.when(F.col("words"), F.concat(runs(OTHER_RUNS), runs(PAIRS, 1))).otherwise(none),
        F.when(F.col("bare"), F.array(F.lit(""))).otherwise(none),
    )
    index = held.select("pkg", "item", "fold", F.explode(F.array_distinct(words)).alias("key")).withColumn("fold", F.when(F.col("key") == "", F.col("fold")))
    asking = forms.select("pkg", "form", "probe", F.explode(F.when(bare, F.array(F.lit(""))).otherwise(F.col("keys"))).alias("key"))
    met = by_key(asking, index, ["pkg", "key"]).where((F.col("key") != "") | F.contains("fold", "probe"))
    return met.select("pkg", "form", "item").distinct()


def _asking(forms: DataFrame, items: DataFrame) -> DataFrame:
    """``items`` with ``forms``: what an item may hold of its package's forms.

    A package with few forms, as nearly all have, brings them to each of its items, where all pieces of a form must be,
    and one of its words where they are plain digits, unless the text isn't ASCII; the items move once. Only items of the
    others are listed by their words.
    """
    sums = stored(forms.groupBy("pkg").agg(F.count("*").alias("n")))
    large = sums.where(F.col("n") > FEW).select("pkg")
    one = F.struct(
        "form", F.regexp_extract_all("form", F.lit(PIECES), F.lit(0)).alias("pieces"),
        F.when((F.size("keys") > 0) & F.forall("keys", lambda k: k.rlike("^[0-9]+$")), F.col("keys")).alias("runs"),
    )
    asked = by_key(forms, sums.where(F.col("n") <= FEW).select("pkg"), "pkg", "left_semi").groupBy("pkg").agg(F.collect_list(one).alias("__asked"))
    plain = F.when(F.col("text").rlike(r"^[\x00-\x7f]*$"), F.lower("text"))  # pieces hold no white space, so that it may stay as it is
    read = items.withColumn("__plain", plain).withColumn("__digits", F.regexp_extract_all("__plain", F.lit(DIGIT_RUNS), F.lit(0)))  # beneath the join, once for an item
    may = lambda f: F.forall(f["pieces"], lambda piece: F.contains(F.col("__plain"), piece)) & (f["runs"].isNull() | F.arrays_overlap(f["runs"], F.col("__digits")))
    held = F.filter("__asked", lambda f: F.col("__plain").isNull() | may(f))
    near = by_key(read, asked, "pkg").select(*items.columns, F.transform(held, lambda f: f["form"]).alias("forms")).where(F.size("forms") > 0)
    if large.isEmpty():
        return near
    theirs = by_key(items, large, "pkg", "left_semi")
    met = by_key(_candidates(by_key(forms, large, "pkg", "left_semi"), theirs), theirs, ["pkg", "item"])
    return near.unionByName(met.withColumn("forms", F.array("form")).drop("form"))


def locate(tokens: DataFrame, items: DataFrame, matcher: str = "normalized", capped: bool = True) -> DataFrame:
    """(pkg, form, locations): where each distinct token of a package stands alone, by item and place.

    Equal tokens of all answers to a package are looked up once. From the item on that would add a 33rd document the
    rest is left, unless not ``capped``: that item is the 33rd of the first items of the form's documents, of which no
    more than so many leave a task. Only forms found in more than 32 items are looked at for that.
    """
    forms = tokens.where("probe <> ''").select("pkg", "form", "probe", "keys").distinct()
    found = _asking(forms, items).withColumn("found", form_places_function(matcher).asNondeterministic()("forms", "text")).drop("forms", "text")
    held = spotted = stored(found.select("*", F.explode("found").alias("f")).select("*", "f.*").drop("found", "f"))
    if capped:
        many = spotted.groupBy("pkg", "form").agg(F.count("*").alias("n")).where(F.col("n") > SOURCE_LIMIT).select("pkg", "form")
        firsts = by_key(spotted, many, ["pkg", "form"], "left_semi").groupBy("pkg", "form", "document_id").agg(F.min("item").alias("first"))
        in_order = Window.partitionBy("pkg", "form").orderBy("first", "document_id")
        ranked = firsts.withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= SOURCE_LIMIT + 1)
        stops = stored(ranked.where(F.col("n") == SOURCE_LIMIT + 1).select("pkg", "form", F.col("first").alias("stop")))
        if not stops.isEmpty():
            held = by_key(spotted, stops, ["pkg", "form"], "left").where(F.col("stop").isNull() | (F.col("item") < F.col("stop")))
    places = F.transform(
        "spans",
        lambda s: F.struct(
            F.col("item"), s["start"].alias("inner_start"), s["end"].alias("inner_end"), "item_id", "document_id", "source_path", "section",
            (F.col("start") + s["start"]).alias("start"), (F.col("start") + s["end"]).alias("end"), "layer", "producer",
        ),
    )
    return held.groupBy("pkg", "form").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("item", places.alias("p")))), lambda x: x["p"])).alias("locations"))


def with_locations(tokens: DataFrame, located: DataFrame) -> DataFrame:
    """Tokens with their locations, an empty array for floating ones."""
    kind = dict(located.dtypes)["locations"]
    out = by_key(tokens, located, ["pkg", "form"], "left")
    return out.withColumn("locations", F.coalesce("locations", F.array().cast(kind)))


def grounded(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.size("locations") > 0)


def floating(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.size("locations") == 0)


def neighbourhood(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """(audit, seg, item, s_start, s_end): evidence sentences that the grounded tokens of a segment lie in."""
    landed = grounded(tokens).select("audit", "pkg", "seg", F.explode("locations").alias("l")).select(
        "audit", "pkg", "seg", F.col("l.item").alias("item"), F.col("l.inner_start").alias("a"), F.col("l.inner_end").alias("b")
    ).distinct()
    sentences = index.select("pkg", "item", "s_start", "s_end").distinct()
    inside = by_key(landed, sentences, ["pkg", "item"]).where(within(F.col("a"), F.col("b"), F.col("s_start"), F.col("s_end")))
    return inside.select("audit", "seg", "item", "s_start", "s_end").distinct()


def _entries(index: DataFrame) -> DataFrame:
    return index.select(
        "pkg", "item", "entry", F.col("kind"), "s_start", "s_end", F.col("digits").alias("e_digits"), F.col("shape").alias("e_shape"),
        F.col("text").alias("e_text"), "item_id", "document_id", "source_path", "section",
        (F.col("base") + F.col("start")).alias("e_start"), (F.col("base") + F.col("end")).alias("e_end"),
    )


def _found() -> Column:
    return F.struct(F.col("e_text").alias("text"), "item_id", "document_id", "source_path", "section", F.col("e_start").alias("start"), F.col("e_end").alias("end"))


def _found_of(index: DataFrame) -> Column:
    """The struct of ``_found`` over columns of the index itself."""
    return F.struct("text", "item_id", "document_id", "source_path", "section", F.col("base").alias("start"), F.col("base").alias("end"))


def _close(lost: DataFrame, entries: DataFrame, near: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of a floating token and an entry of an item that its segment stands in; scope 0 is the same sentence, 1 the same item."""
    its = near.groupBy("audit", "seg", "item").agg(F.collect_set(F.struct("s_start", "s_end")).alias("sentences"))
    both = by_key(by_key(lost, its, ["audit", "seg"]), entries, [*on, "item"])
    inside = F.array_contains("sentences", F.struct("s_start", "s_end"))
    return both.withColumn("scope", F.when(inside, 0).otherwise(1)).drop("sentences")


def explain(tokens: DataFrame, index: DataFrame, near: DataFrame) -> DataFrame:
    """(audit, seg, tok, contradiction): the one evidence token with the same digits and another unit, if there is one.

    Candidates are of the same kind, have the same digits, at least one, and another shape. The tightest scope
    that holds exactly one decides. For the scope of a whole package the entries are summed by shape first, so
    what a token meets is the shapes its digits are written in, not each place of them.
    """
    lost = floating(tokens).where("digits <> ''").select("audit", "pkg", "seg", "tok", "kind", "digits", "shape")
    entries, key = _entries(index).withColumnRenamed("e_digits", "digits"), ["audit", "seg", "tok", "kind"]
    local = _close(lost, entries, near, ["pkg", "kind", "digits"]).where("shape <> e_shape").groupBy(*key).agg(
        F.count_if(F.col("scope") == 0).alias("n0"), F.count("*").alias("n1"), F.min_by(_found(), F.struct("scope", "item", "entry")).alias("inner")
    )
    shapes = entries.groupBy("pkg", "kind", "digits", "e_shape").agg(F.count("*").alias("n"), F.min(F.struct("item", "entry", _found().alias("f"))).alias("first"))
    whole = by_key(lost, shapes, ["pkg", "kind", "digits"]).where("shape <> e_shape").groupBy(*key).agg(F.sum("n").alias("n2"), F.min("first").alias("outer"))
    counted = by_key(whole, local, key, "left")
    where = F.when(F.col("n0") == 1, "sentence").when((F.coalesce("n0", F.lit(0)) == 0) & (F.col("n1") == 1), "item").when(
        F.col("n1").isNull() & (F.col("n2") == 1), "package"
    )
    why = F.concat(F.lit("the one "), "kind", F.lit(" with these digits in the "), where, F.lit(" is written with another unit"))
    told = counted.withColumn("found", F.coalesce("inner", F.col("outer.f"))).where(where.isNotNull())
    return told.select("audit", "seg", "tok", F.struct("found.*", why.alias("why")).alias("contradiction"))


def nearby(tokens: DataFrame, index: DataFrame, near: DataFrame, most: int = NEARBY, front: int = 64) -> DataFrame:
    """(audit, seg, tok, nearby): what the evidence does say of that kind, tightest scope first, then in its order.

    Beyond the items that a segment stands in, only a package's first entries matter: a token meets the ``front``
    first of its kind, and all of them only where those didn't fill its list, so that a package with many floating
    tokens and many entries isn't multiplied out.
    """
    lost = floating(tokens).select("audit", "pkg", "seg", "tok", "kind", "text")
    in_order = Window.partitionBy("pkg", "kind").orderBy("item", "entry")
    entries, key = _entries(index), ["audit", "seg", "tok"]
    its = near.select("audit", "seg", "item").distinct()
    local = _close(lost, entries, near, ["pkg", "kind"])
    order = Window.partitionBy(*key).orderBy("scope", "item", "entry")

    def far(asking: DataFrame, among: DataFrame) -> DataFrame:
        pairs = by_key(asking, among, ["pkg", "kind"]).where("text <> e_text")
        return by_key(pairs, its, ["audit", "seg", "item"], "left_anti").withColumn("scope", F.lit(2))

    def ranked(pairs: DataFrame) -> DataFrame:
        rows = pairs.where("text <> e_text").select("pkg", "kind", *key, "scope", "item", "entry", _found().alias("f"))
        return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)

    head = entries.withColumn("place", F.row_number().over(in_order)).where(F.col("place") <= front).drop("place")
    first = ranked(local.unionByName(far(lost, head), allowMissingColumns=True))
    sizes = entries.groupBy("pkg", "kind").agg(F.count("*").alias("entries")).where(F.col("entries") > front)
    full = first.where(F.col("n") == most).select(*key)
    short = stored(by_key(by_key(lost, sizes.select("pkg", "kind"), ["pkg", "kind"], "left_semi"), full, key, "left_anti"))
    every = first
    if not short.isEmpty():
        again = ranked(by_key(local, short.select(*key), key, "left_semi").unionByName(far(short, entries), allowMissingColumns=True))
        every = by_key(first, short.select(*key), key, "left_anti").unionByName(again)
    listed = F.array_sort(F.collect_list(F.struct("n", "f")))
    return every.groupBy(*key).agg(F.transform(listed, lambda x: x["f"]).alias("nearby"))


def placed_tokens(segs: DataFrame, items: DataFrame, matcher: str = "normalized", capped: bool = True) -> DataFrame:
    """Tokens of segments with their locations: all that shares are made of."""
    tokens = tokens_of(segs)
    return with_locations(tokens, locate(tokens, items, matcher, capped))


def _may_contradict(lost: DataFrame, items: DataFrame) -> DataFrame:
    """Items of packages with floating tokens, without those that hold the digits of none of them.

    An entry has a floating token's digits only if they stand among its item's, which plain digits show; other texts stay.
    """
    asked = lost.groupBy("pkg").agg(F.collect_set("digits").alias("asked"))
    own = F.when(F.col("text").rlike(r"^[\x00-\x7f]*$"), F.regexp_replace("text", "[^0-9]+", ""))
    both = by_key(items.withColumn("__own", own), asked, "pkg")
    return both.where(F.col("__own").isNull() | F.exists("asked", lambda d: F.contains(F.col("__own"), d))).drop("asked", "__own")


def checked_tokens(segs: DataFrame, items: DataFrame, codes=None, matcher: str = "normalized", neighbours: bool = True) -> DataFrame:
    """Tokens with locations, contradiction and nearby; the last two only where a token floats.

    Evidence is cut into sentences and indexed only for packages that some token floats in, and without ``neighbours``,
    where ``nearby`` is null, only items that hold the digits of such a token. Each item goes where its text's hash falls,
    so that a large package isn't the work of one task. Verdicts don't depend on what is nearby.
    """
    placed = stored(placed_tokens(segs, items, matcher))
    lost = floating(placed)
    if neighbours:
        open_items = by_key(items, lost.select("pkg").distinct(), "pkg", "left_semi")
    else:
        lost = lost.where("digits <> ''")
        open_items = _may_contradict(lost, items)
    index = stored(source_index(alike(open_items, "text", "pkg", "item"), codes))
    near = neighbourhood(by_key(placed, lost.select("pkg").distinct(), "pkg", "left_semi"), index)
    told, key = stored(explain(placed, index, near)), ["audit", "seg", "tok"]
    whole = by_key(placed, told, key, "left")
    if not neighbours:
        kind = f"array<{dict(index.select(_found_of(index).alias('f')).dtypes)['f']}>"
        return whole.withColumn("nearby", F.lit(None).cast(kind))
    open_ones = by_key(placed, told.select(*key), key, "left_anti")
    return by_key(whole, nearby(open_ones, index, near), key, "left")


def verdict(kind: Column, residue: Column, tokens: Column) -> Column:
    """What became of a segment, the first of the conditions that holds."""
    return (
        F.when(kind == "code", "unchecked")
        .when(F.size(residue) > 0, "unverifiable")
        .when(F.size(tokens) == 0, "unbearing")
        .when(F.exists(tokens, lambda t: t["contradiction"].isNotNull()), "contradicted")
        .when(F.forall(tokens, lambda t: F.size(t["locations"]) > 0), "grounded")
        .otherwise("floating")
    )


def checked_segments(segs: DataFrame, tokens: DataFrame) -> DataFrame:
    """Segments with their tokens in order and their verdict; ``segs`` has ``residue``, the placeholders in each."""
    listed = F.array_sort(
        F.collect_list(F.struct("tok", "kind", "text", "start", "end", "locations", "contradiction", "nearby"))
    )
    by = tokens.groupBy("audit", "seg").agg(listed.alias("found"))
    both = by_key(segs.drop("tokens"), by, ["audit", "seg"], "left")
    kind = dict(both.dtypes)["found"]
    looked = (F.col("kind") != "code") & (F.size("residue") == 0)
    kept = F.when(looked, F.coalesce("found", F.array().cast(kind))).otherwise(F.array().cast(kind))
    ready = both.withColumn("tokens", kept).drop("found")
    named = F.array_join(F.transform(F.slice("residue", 1, 3), lambda r: r["token"]), ", ")
    more = F.when(F.size("residue") > 3, ", ...").otherwise("")
    out = ready.withColumn("verdict", verdict(F.col("kind"), F.col("residue"), F.col("tokens")))
    return out.withColumn(
        "because",
        F.when(F.col("verdict") == "unchecked", "a code block: its numbers are seldom claims about the world").when(
            F.col("verdict") == "unverifiable",
            F.concat(F.lit("a redacted value stands here ("), named, more, F.lit("); what it was is unknown, not wrong")),
        ),
    )


def segment_ids(seg: Column) -> Column:
    return F.format_string("seg_%03d", seg + 1)


def verdict_sums() -> list[Column]:
    return [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]


def verdict_counts(segs: DataFrame, *keys: str) -> DataFrame:
    """A count for every verdict, zero where there is none."""
    return segs.groupBy(*keys).agg(*verdict_sums())


def coverage_sums() -> list[Column]:
    n = F.size("tokens")
    up = F.size(F.filter("tokens", lambda t: F.size(t["locations"]) > 0))
    return [
        F.count("*").alias("segments"), F.count_if(n > 0).alias("bearing"), F.count_if(F.col("verdict") == "unbearing").alias("unbearing"),
        F.count_if(F.col("verdict").isin(*UNEXAMINED)).alias("unexamined"), F.sum(n.cast("long")).alias("particulars"), F.sum(up.cast("long")).alias("grounded_tokens"),
    ]


def coverage(segs: DataFrame, *keys: str) -> DataFrame:
    """Segments by what could be said of them, tokens by standing, and the grounded share (null if none was checked)."""
    sums = segs.groupBy(*keys).agg(*coverage_sums())
    return sums.withColumn("floating_tokens", F.col("particulars") - F.col("grounded_tokens")).withColumn(
        "grounded_share", F.try_divide(F.col("grounded_tokens"), F.col("particulars"))
    )


def skipped() -> Column:
    """Whether nothing was checked in a segment."""
    return F.col("verdict").isin("unbearing", *UNEXAMINED)


def skip_rule() -> Column:
    return F.when(F.col("verdict") == "unchecked", "not_prose").when(F.col("verdict") == "unverifiable", "protected").otherwise("no_particulars")


def skip_reason() -> Column:
    return F.coalesce("because", F.lit("the segment states something but holds no token that can be checked"))


def skips(segs: DataFrame) -> DataFrame:
    """Every segment about which nothing was checked, with the rule and the reason."""
    return segs.where(skipped()).select("audit", "seg", "start", "end", skip_rule().alias("rule"), skip_reason().alias("reason"))


def withheld_by_rule(omissions: DataFrame, *keys: str) -> DataFrame:
    return omissions.groupBy(*keys, "rule").agg(F.count("*").alias("n"))
