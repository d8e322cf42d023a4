"""Information-theoretic sanitisation of personal data, in DataFrame and SQL functions alone.

Protected entities are e-mail addresses, IPv4 addresses, card numbers and phone numbers (KINDS). Terms are runs of
four or more letters. Over the corpus, counting each distinct text once: n(e) texts hold entity e, n(t) hold term t,
n(t, e) hold the whole of t within the CONTEXT characters of the text before or after e, whatever else stands there. Knowing t reveals log2(n(t, e) N / (n(t) n(e))) bits about e
(pointwise mutual information). A term discloses e if n(t, e) >= SUPPORT, its bits are at least BITS and
P(e | t) = n(t, e) / n(t) is at least SHARE: who guesses e from t alone is then right as often as not. Every
occurrence of such a term outside of the entities' own spans is a span of kind `term`; it is removed from P = REMOVE
on, else generalised to its initial.

Positions count code points, ends are exclusive. Matches of a kind that fail its test are dropped and not tried
again. Patterns use possessive repeats, which match the same strings here and run in constant stack and linear time.
Null text is empty; rows that repeat have equal results and count once as evidence; null ids are no keys by
themselves (a row is known by its id and text together). Empty tables give no rows. redact() keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import Scratch

CONTEXT, SUPPORT, BITS, SHARE, REMOVE = 80, 3, 4.0, 0.5, 0.9
SPANS, BLOCK = "array<struct<kind:string,start:int,end:int,value:string>>", 1024
#: Kind, cheap test of a text, pattern, SQL test of a match m.
KINDS = (
    ("email", "contains(text, '@')", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    ("ip", r"text rlike '[0-9]\\.[0-9]'", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"forall(split(m, '\\.'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"),
    ("card", "text rlike '[0-9][ -]?[0-9]'", r"[0-9](?:[\x20-]?+[0-9])++", "length(regexp_replace(m, '[^0-9]', '')) between 13 and 19 and luhn_check(regexp_replace(m, '[^0-9]', ''))"),
    ("phone", "contains(text, '+')", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15"),
)
TERM = r"\p{L}{4,}+"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bound(value: str, name: str, body: str) -> str:
    """SQL of body with name bound to value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _before(numbers: str, fold: str, tag: str) -> str:
    """SQL: for each of an array of ints the fold, from 0, of those that stand before it. fold: SQL over s and v.

    Appending to an array copies it, so the array is folded in blocks of the cube root of its size: n^(4/3) steps for
    n numbers, where a plain fold takes n^2. tag keeps names of nested calls apart.
    """
    x, c, s, v, w = (f"{n}_{tag}" for n in "xcsvw")
    step = fold.replace("{s}", f"{s}.at").replace("{v}", v)
    scan = lambda of, base: f"aggregate({of}, named_struct('at', {base}, 'out', cast(array() as array<int>)), ({s}, {v}) -> named_struct('at', {step}, 'out', concat({s}.out, array({s}.at))), {s} -> {s}.out)"
    whole = f"aggregate({w}, 0, ({s}, {v}) -> {fold.replace('{s}', s).replace('{v}', v)})"
    blocks = f"transform(sequence(0, (size({x}) - 1) div {c}), k_{tag} -> slice({x}, k_{tag} * {c} + 1, {c}))"
    folded = _bound(blocks, f"b_{tag}", f"flatten(zip_with(b_{tag}, {scan(f'transform(b_{tag}, {w} -> {whole})', '0')}, (o_{tag}, at_{tag}) -> {scan(f'o_{tag}', f'at_{tag}')}))")
    return _bound(numbers, x, f"case when size({x}) = 0 then cast(array() as array<int>) else {_bound(f'cast(ceil(cbrt(size({x}))) as int)', c, folded)} end")


def _spans(text: str, pattern: str, kind: str, when: str, test: str) -> str:
    """SQL: array of (kind, start, end, value) of the matches of a pattern that pass its test.

    split() gives what lies between the matches that regexp_extract_all() gives, so places are running lengths.
    """
    none = f"cast(array() as {SPANS})"
    at = _before("transform(z.hits, (m, i) -> length(z.gaps[i]) + length(m))", "{s} + {v}", "at")
    part = f"transform(z.hits, (m, i) -> named_struct('kind', '{kind}', 'start', ats[i] + length(z.gaps[i]), 'end', ats[i] + length(z.gaps[i]) + length(m), 'value', m))"
    found = _bound(at, "ats", f"filter({part}, s -> {_bound('s.value', 'm', test)})")
    both = _bound(f"named_struct('hits', regexp_extract_all({text}, {pattern}, 0), 'gaps', split({text}, {pattern}, -1))", "z", found)
    return f"case when {when} then {both} else {none} end"


def _cut(start: str, end: str, blocks: str = "blocks") -> str:
    """SQL: characters start to end of the text in blocks of BLOCK characters; the length of the text before them costs nothing."""
    return f"substring(array_join(slice({blocks}, {start} div {BLOCK} + 1, {end} div {BLOCK} - {start} div {BLOCK} + 1), ''), {start} % {BLOCK} + 1, {end} - {start})"


def _blocks(when: str) -> str:
    return f"case when {when} then regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0) else cast(array() as array<string>) end"


def _replaced(rows: DataFrame, marks: str, name: str, label: str = "h.label") -> DataFrame:
    """Adds name: the column text with the marks (start, end, label) put in place; marks that overlap are one, with the first one's label.
    label: SQL over that mark h and the ends of all, of which ends[j] is its own."""
    ends = _before("transform(marks, x -> x.end)", "greatest({s}, {v})", "end")
    heads = "filter(transform(marks, (x, i) -> named_struct('i', i, 'start', x.start, 'label', x.label)), h -> h.i = 0 or h.start >= reach[h.i])"
    last = "transform(heads, (h, j) -> case when j + 1 < size(heads) then reach[heads[j + 1].i] else array_max(transform(marks, x -> x.end)) end)"
    done = f"concat(array_join(transform(heads, (h, j) -> concat({_cut('(case when j = 0 then 0 else ends[j - 1] end)', 'h.start')}, {label})), ''), {_cut('ends[size(ends) - 1]', 'length(text)')})"
    rows = rows.withColumn("marks", F.expr(f"array_sort({marks})")).withColumn("blocks", F.expr(_blocks("size(marks) > 0")))
    put = _bound(ends, "reach", _bound(heads, "heads", _bound(last, "ends", done)))
    return rows.withColumn(name, F.expr(f"case when size(marks) = 0 then text else {put} end")).drop("marks", "blocks")


def base_spans(text: Column | str) -> list[tuple[str, str]]:
    """Kind and SQL of its spans in a column named text."""
    return [(kind, _spans("text", _quoted(pattern), kind, when, test)) for kind, when, pattern, test in KINDS]


def _written(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base (the base spans of all kinds, as listed, then by start) and around: kind, value, and what stands before and after, CONTEXT characters and one more."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("text_key"), *[F.expr(sql).alias(kind) for kind, sql in base_spans("text")])
    rows = rows.select("doc_id", "text_key", "text", F.concat(*[F.col(kind) for kind, *_ in KINDS]).alias("base"))
    rows = rows.withColumn("z", F.expr(f"named_struct('blocks', {_blocks('size(base) > 0')}, 'chars', length(text))"))  # once for a text, not for a span
    before, after = _cut(f"greatest(s.start - {CONTEXT + 1}, 0)", "s.start", "z.blocks"), _cut("s.end", f"least(s.end + {CONTEXT + 1}, z.chars)", "z.blocks")
    around = _bound("z", "z", f"transform(base, s -> named_struct('kind', s.kind, 'value', s.value, 'before', {before}, 'after', {after}))")
    return rows.select("doc_id", "text_key", "base", F.expr(around).alias("around"))


def _normal(kind: str, value: str) -> str:
    return f"case when {kind} in ('card', 'phone') then concat({kind}, regexp_replace({value}, '[^0-9]', '')) else concat({kind}, lower({value})) end"


def disclosing_terms(spark: SparkSession, docs: DataFrame, found: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame | None:
    """term, share: terms whose disclosure of an entity is over the thresholds; None if there is none. found: find(docs), written."""
    letters = _quoted(TERM)
    ends = {"before": _quoted(r"^\p{L}++"), "after": _quoted(r"\p{L}++\z")}  # a run of letters that reaches beyond the context is no term of it
    before, after = [f"regexp_extract_all(lower(case when length(s.{n}) > {CONTEXT} then regexp_replace(s.{n}, {end}, '') else s.{n} end), {letters}, 0)" for n, end in ends.items()]
    seen = found.where("size(base) > 0").select("text_key", F.explode("around").alias("s")).select("text_key", F.expr(_normal("s.kind", "s.value")).alias("entity"), F.expr(f"concat({before}, {after})").alias("terms"))
    pairs = seen.select("text_key", "entity", F.explode("terms").alias("term")).distinct()
    beside = pairs.groupBy("term").agg(F.countDistinct("text_key").alias("n_c"))  # texts with the term beside any entity: at most n(t)
    joint = pairs.groupBy("term", "entity").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= SUPPORT)
    joint = scratch.write(joint.join(beside, "term").where(F.col("n_te") >= F.col("n_c") * SHARE).drop("n_c"), "joint")
    if joint.isEmpty():
        return None
    entities = seen.select("text_key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    wanted = joint.select("term").distinct()
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(F.xxhash64("text").alias("text_key"), F.explode(F.expr(f"regexp_extract_all(lower(text), {letters}, 0)")).alias("term"))
    counts = texts.join(wanted, "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    total = found.select("text_key").distinct().count()
    scored = joint.join(counts, "term").join(entities, "entity").where(F.col("n_te") >= F.col("n_t") * SHARE).where(F.log2(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e"))) >= BITS)
    terms = scratch.write(scored.groupBy("term").agg(F.max(F.col("n_te") / F.col("n_t")).alias("share")), "terms")
    return None if terms.isEmpty() else terms


#: Terms or spans of a table that is broadcast (some 100 bytes each); beyond it the join shuffles.
BROADCAST_TERMS = 200_000


def _sized(df: DataFrame, column: str, scratch: Scratch, name: str) -> DataFrame:
    """df as a written table, to be broadcast if its arrays are few, so that texts stay where they are."""
    held = scratch.write(df, name)
    n = held.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]
    return F.broadcast(held) if n <= BROADCAST_TERMS else held


def term_spans(docs: DataFrame, terms: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key_id, text_key, found, shares: spans of kind term in each distinct row that has one, outside of its base spans (these are
    blanked before terms are looked for), and the share of each term."""
    rows = docs.select(F.col(id_col).cast("long").alias("key_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = rows.select("key_id", F.xxhash64("text").alias("text_key"), F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(text), {_quoted(TERM)}, 0)"))).alias("term"))
    has = words.join(terms, "term").groupBy("key_id", "text_key").agg(F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias("shares"))
    has = _sized(has, "shares", scratch, "has")
    texts = rows.withColumn("text_key", F.xxhash64("text")).alias("r").join(has.alias("h"), F.expr("r.key_id <=> h.key_id and r.text_key = h.text_key")).select("r.key_id", "r.text_key", "text", "shares").dropDuplicates(["key_id", "text_key"])
    texts = texts.withColumn("base", F.concat(*[F.expr(sql) for _, sql in base_spans("text")]))
    texts = _replaced(texts, "transform(base, s -> named_struct('start', s.start, 'end', s.end, 'label', ''))", "bare", "repeat(' ', ends[j] - h.start)")
    texts = texts.withColumn("pattern", F.expr(r"concat('(?iu)(?<!\\p{L})(?:', array_join(sort_array(map_keys(shares)), '|'), ')(?!\\p{L})')"))
    return _sized(texts.select("key_id", "text_key", F.expr(_spans("bare", "pattern", "term", "true", "true")).alias("found"), "shares"), "found", scratch, "term_spans")


def report(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs."""
    scratch = Scratch(spark, "pii")
    found = scratch.write(find(docs, id_col, text_col), "found")
    terms = disclosing_terms(spark, docs, found, scratch, text_col)
    rows = found.withColumn("base_text", F.expr(_written("base")))
    if terms is None:
        rows = rows.withColumn("spans", F.col("base_text"))
    else:
        more = term_spans(docs, terms, scratch, id_col, text_col)
        rows = rows.alias("r").join(more.alias("t"), F.expr("r.doc_id <=> t.key_id and r.text_key = t.text_key"), "left").select("doc_id", "base", "base_text", "found")
        rows = rows.withColumn("spans", F.expr(f"coalesce({_written('concat(base, found)')}, base_text)"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind, *_ in KINDS]
    return rows.select("doc_id", *counts, F.sha2("base_text", 256).alias("base_sha256"), "spans")


def redact(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs; in their texts entities become [KIND], terms [TERM] or their initial and an ellipsis. Null text stays null."""
    scratch = Scratch(spark, "pii")
    found = scratch.write(find(docs, id_col, text_col), "found")
    terms = disclosing_terms(spark, docs, found, scratch, text_col)
    names = [f"c{k}" for k in range(len(docs.columns))]
    text, key = f"c{docs.columns.index(text_col)}", f"c{docs.columns.index(id_col)}"
    rows = docs.toDF(*names).withColumn("text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.withColumn("base", F.concat(*[F.expr(sql) for _, sql in base_spans("text")]))
    label = "named_struct('start', s.start, 'end', s.end, 'label', concat('[', upper(s.kind), ']'))"
    marks = f"transform(base, s -> {label})"
    if terms is not None:
        rows = rows.withColumn("text_key", F.xxhash64("text")).alias("r").join(term_spans(docs, terms, scratch, id_col, text_col).alias("t"), F.expr(f"cast(r.{key} as bigint) <=> t.key_id and r.text_key = t.text_key"), "left").select(*[f"r.{n}" for n in names], "text", "base", "found", "shares")
        soft = f"named_struct('start', s.start, 'end', s.end, 'label', case when coalesce(shares[lower(s.value)], 1.0) >= {REMOVE} then '[TERM]' else concat(left(s.value, 1), '…') end)"
        marks = f"concat({marks}, coalesce(transform(found, s -> {soft}), cast(array() as array<struct<start:int,end:int,label:string>>)))"
    rows = _replaced(rows, marks, "clean").withColumn("clean", F.when(F.col(text).isNotNull(), F.col("clean")))
    return rows.select(*[F.col("clean" if n == text else n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
