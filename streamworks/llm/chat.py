"""Chat formatting: records of any known layout become turns, and turns one reversible training text.

Layouts are recognised by their schema, not by trial: the paths of a record's nested fields (those of a JSON text, or the fields of
a struct) are listed, to ``DEPTH`` levels and over all members of lists, with the kind (text, list, object) of those that a mapping reads as a text or a list; fields that
are null are absent. Of them those count that any mapping names, so ids, sources, tools and other fields don't matter; their hash picks a declarative ``Mapping`` from a
registry: which field is the list of turns or, without one, which fields are turns of which role, lists of messages or lists of earlier exchanges. A record whose hash
no mapping has may still have that of a list of turns beside fields of other layouts. Texts may be lists of parts, whose texts are joined. A record of an unknown
fingerprint gives no turns and says so (``layout`` null), and ``unread`` names the fields of any record that no turn was made of.
Spark's JSON functions read texts of up to 20 million characters; structs have no such limit.

The template marks a turn ``[INST]...[/INST]`` for the user, ``[SYS]...[/SYS]`` for the system, ``<s>...</s>`` for
the assistant and ``[ROLE]name[TEXT]...[/ROLE]`` for any other role. Control strings inside texts and role names get a backslash
after their first character (one more if some stand there already), which reading back takes away again, so any text survives. The
assistant's texts are the loss mask.

Only DataFrame functions are used. A conversation is one row of the result, so its turns meet in one task, and no more than they.

Defined results: null texts and roles are empty; turns are in order of turn, then role, then text (null turns first); repeated rows
are repeated turns; a null id is a conversation; an empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

#: Opening and closing control strings by role.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
#: A control string, with the backslashes that escape it after its first character.
CONTROL = r"(\[)(\\*)(/?(?:INST|SYS|ROLE)\]|TEXT\])|(<)(\\*)(/?s>)"
ESCAPED = CONTROL.replace(r"(\\*)", r"\\(\\*)")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$4$2$5$3$6")


#: In place of a role: a list of messages, and a list of earlier exchanges (what the user and what the assistant said).
MESSAGES, EXCHANGES = "*", "**"


@dataclass(frozen=True)
class Mapping:
    """``turns``: path of the list of turns, ``role`` and ``text`` the fields in it; ``single``: (role, path) in order, before the list if there is one.

    A path in ``single`` may be several, whose texts are one turn, an empty line between them; the role may be ``MESSAGES`` or ``EXCHANGES``. Empty system texts
    are left out. ``paths`` must all be there, those of ``optional`` may be (some that come together stand in one text). With ``parts`` a turn's text is a
    list of parts with a text each."""

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "text"
    single: tuple[tuple[str, str | tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    parts: bool = False

    @property
    def fingerprints(self) -> list[Column]:
        """One for each choice of optional paths."""
        chosen = [" ".join(c).split() for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return [F.xxhash64(F.lit("\n".join(sorted({*self.paths, *c})))) for c in chosen]

    @property
    def read(self) -> list[str]:
        """The paths that turns are made of, without the list of turns."""
        return [p for _, paths in self.single for p in ([paths] if isinstance(paths, str) else paths)]

    @property
    def fields(self) -> set[str]:
        """The outermost fields that turns are made of."""
        return {p.partition(".")[0] for p in (*self.read, *([self.turns] if self.turns else []))}


def listed(path: str) -> tuple[str, ...]:
    """The paths of a list of messages."""
    return path, f"{path}[]", f"{path}[].content", f"{path}[].role"


SAME_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
CONTENT = ("messages", "messages[].content", "messages[].role")
SYSTEM, HISTORY = ("system", "system"), (EXCHANGES, "history")
BEFORE = ("system", "history history[]")


def _exchange(name: str, asked: str | tuple[str, ...], said: str, paths: tuple[str, ...], optional: tuple[str, ...] = BEFORE) -> Mapping:
    return Mapping(name, paths, single=(SYSTEM, HISTORY, ("user", asked), ("assistant", said)), optional=optional)


#: Field paths are those of objects; [] stands for the members of a list, and at the end for a list itself, {} for an object.
FLAT = (
    _exchange("prompt", "prompt", "completion", ("completion", "prompt")),
    _exchange("answer", "prompt", "response", ("prompt", "response")),
    _exchange("instruction", "instruction", "output", ("instruction", "output"), BEFORE[1:]),
    _exchange("instruction with input", ("instruction", "input"), "output", ("input", "instruction", "output")),
    _exchange("instruction with system", "instruction", "output", ("instruction", "output", "system"), BEFORE[1:]),
    _exchange("question", "question", "answer", ("answer", "question")),
    _exchange("query", "query", "response", ("query", "response")),
    _exchange("preferred", "prompt", "chosen", ("chosen", "prompt", "rejected")),
)
MAPPINGS = (
    Mapping("turns", ("conversation", "conversation[].role", "conversation[].text"), turns="conversation"),
    Mapping("messages", CONTENT, turns="messages", text="content", single=(SYSTEM,), optional=("prompt", "system")),
    Mapping("messages of parts", (*CONTENT, "messages[].content[].text"), turns="messages", text="content", parts=True, single=(SYSTEM,), optional=("prompt", "system")),
    Mapping("shared", ("conversations", "conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", single=(SYSTEM,), roles=SAME_ROLES, optional=("system",)),
    Mapping("prompt of messages", (*listed("completion"), *listed("prompt")), single=(SYSTEM, (MESSAGES, "prompt"), (MESSAGES, "completion")), optional=("system",)),
    Mapping("completion of messages", ("completion", *listed("prompt")), single=(SYSTEM, (MESSAGES, "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("answer to messages", (*listed("prompt"), "response"), single=(SYSTEM, (MESSAGES, "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("preferred messages", (*listed("chosen"), *listed("rejected")), single=(SYSTEM, (MESSAGES, "chosen")), optional=("prompt", "system")),
    *FLAT,
    # the same fields, one level further down
    *(
        Mapping(
            f"nested {m.name}", ("data", *(f"data.{p}" for p in m.paths)), optional=tuple(" ".join(f"data.{p}" for p in o.split()) for o in m.optional),
            single=tuple((r, f"data.{p}" if isinstance(p, str) else tuple(f"data.{q}" for q in p)) for r, p in m.single),
        )
        for m in FLAT
    ),
)
#: How deep fields are listed; no mapping names deeper ones.
DEPTH = 4


def _single_paths(mappings: tuple[Mapping, ...]) -> list[str]:
    """The paths whose kind counts: those that are read whole, and those that a mapping wants as a list."""
    lists = {p[:-2] for m in mappings for p in (*m.paths, *" ".join(m.optional).split()) if p.endswith("[]")}
    return sorted(lists | {p for m in mappings for p in m.read})


def _named(mappings: tuple[Mapping, ...]) -> Column:
    named = {p for m in mappings for p in (*m.paths, *" ".join(m.optional).split())}
    return F.array(*[F.lit(p) for p in sorted(named | {p + kind for p in _single_paths(mappings) for kind in ("[]", "{}")})])


def field_paths(record: Column, depth: int = DEPTH, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The paths of a JSON text's fields that aren't null, each once: of nested objects, and of all members of lists of objects. Fields that a mapping reads
    whole have their kind as well: a list has its path with [], an object with {}."""
    none, whole = F.array().cast("array<string>"), _single_paths(mappings)

    def kind(value: Column, name: Column, path: Column) -> Column:
        own = F.call_function("try_variant_get", F.call_function("try_parse_json", value), F.concat(F.lit("$['"), name, F.lit("']")), F.lit("variant"))
        said = F.call_function("schema_of_variant", own)
        mark = F.when(said.startswith("ARRAY"), F.array(F.concat(path, F.lit("[]")))).when(said.startswith("OBJECT"), F.array(F.concat(path, F.lit("{}")))).otherwise(none)
        return F.when(path.isin(whole), mark).otherwise(none)

    def below(value: Column, prefix: Column, left: int) -> Column:
        """Paths under one JSON value: an object's fields, or those of a list's members."""
        keys = F.coalesce(F.json_object_keys(value), none)

        def field(name: Column) -> Column:
            inner = F.call_function("get_json_object", value, F.concat(F.lit("$['"), name, F.lit("']")))
            path = F.concat(prefix, name)
            return F.when(inner.isNull(), none).otherwise(F.concat(F.array(path), kind(value, name, path), of_value(inner, path, left - 1)) if left > 1 else F.array(path))

        return F.flatten(F.transform(keys, field))

    def of_value(value: Column, path: Column, left: int) -> Column:
        members = F.coalesce(F.from_json(value, "array<string>"), none)
        listed = F.flatten(F.transform(members, lambda m: F.when(m.startswith("{"), below(m, F.concat(path, F.lit("[].")), left)).otherwise(none)))
        return F.when(value.startswith("["), F.array_distinct(listed)).when(value.startswith("{"), below(value, F.concat(path, F.lit(".")), left)).otherwise(none)

    return F.array_distinct(below(record, F.lit(""), depth))


def struct_paths(record: Column, schema: T.StructType, depth: int = DEPTH, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The same for a struct."""
    none, whole = F.array().cast("array<string>"), _single_paths(mappings)

    def marked(path: str, kind: T.DataType) -> Column:
        mark = "[]" if isinstance(kind, T.ArrayType) else "{}" if isinstance(kind, T.StructType) else ""
        return F.array(F.lit(path), F.lit(path + mark)) if mark and path in whole else F.array(F.lit(path))

    def below(value: Column, kind: T.StructType, prefix: str, left: int) -> Column:
        each = [F.when(value[f.name].isNull(), none).otherwise(F.concat(marked(prefix + f.name, f.dataType), of_value(value[f.name], f.dataType, prefix + f.name, left - 1))) for f in kind]
        return F.concat(none, *each)

    def of_value(value: Column, kind: T.DataType, path: str, left: int) -> Column:
        if left < 1:
            return none
        if isinstance(kind, T.StructType):
            return below(value, kind, f"{path}.", left)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.array_distinct(F.flatten(F.transform(value, lambda m: F.coalesce(below(m, kind.elementType, f"{path}[].", left), none))))
        return none

    return F.array_distinct(below(record, schema, "", depth))


def schema_fingerprint(record: Column, schema: T.StructType | None = None, mappings: tuple[Mapping, ...] = MAPPINGS, paths: Column | None = None) -> Column:
    """The hash of the record's paths that mappings name, in order."""
    own = paths if paths is not None else struct_paths(record, schema, mappings=mappings) if schema else field_paths(record, mappings=mappings)
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(own, _named(mappings))), "\n"))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


TURNS = "array<struct<role:string,text:string>>"


def _listed_turns(listed: Column, m: Mapping, text) -> Column:
    listed = F.filter(listed, lambda t: t.isNotNull())
    role = lambda t: t[m.role]
    if m.roles:
        known = F.create_map(*[F.lit(x) for p in m.roles for x in p])
        role = lambda t: F.coalesce(F.try_element_at(known, t[m.role]), t[m.role])
    return F.coalesce(F.transform(listed, lambda t: _turn(role(t), text(t))), F.array().cast(TURNS))


def _texts_of_parts(text: Column) -> Column:
    """A text, or the joined texts of a JSON list of parts."""
    parts = F.transform(F.from_json(text, "array<struct<text:string>>"), lambda p: F.coalesce(p["text"], F.lit("")))
    return F.when(text.startswith("[{"), F.coalesce(F.array_join(parts, ""), text)).otherwise(text)


def _at(record: Column, path: str) -> Column:
    for name in path.split("."):
        record = record[name]
    return record


def _has(schema: T.StructType, path: str) -> T.DataType | None:
    kind: T.DataType = schema
    for name in path.replace("[]", ".[]").split("."):
        if name == "[]":
            kind = getattr(kind, "elementType", None)
        elif isinstance(kind, T.StructType) and name in kind.names:
            kind = kind[name].dataType
        else:
            return None
    return kind


def _mapped(record: Column, m: Mapping, schema: T.StructType | None) -> Column | None:
    """The turns by one mapping; None if a struct's schema can't have them."""
    if schema and any(_has(schema, p) is None for p in m.paths if p[-2:] not in ("[]", "{}")):
        return None
    first = _singles(record, m, schema)
    if first is None:
        return None
    if m.turns:
        listed = _of_list(record, m, schema)
        return None if listed is None else F.concat(first, listed) if m.single else listed
    return first


def _singles(record: Column, m: Mapping, schema: T.StructType | None) -> Column | None:
    """The turns of single fields and of lists of messages or exchanges; None if a struct has other kinds there."""
    none, groups = F.array().cast(TURNS), []
    for role, paths in m.single:
        paths = [paths] if isinstance(paths, str) else paths
        kinds = [_has(schema, p) if schema else T.StringType() for p in paths]
        if None in kinds:
            continue  # an optional field that the struct hasn't
        value = [_at(record, p) if schema else F.call_function("get_json_object", record, F.lit("$." + p)) for p in paths]
        if role in (MESSAGES, EXCHANGES):
            of = "array<struct<role:string,content:string>>" if role == MESSAGES else "array<array<string>>"
            if schema and (not isinstance(kinds[0], T.ArrayType) or (role == MESSAGES) != isinstance(kinds[0].elementType, T.StructType)):
                if role == MESSAGES:
                    return None
                continue
            items = F.filter(value[0] if schema else F.from_json(value[0], of), lambda t: t.isNotNull())
            if role == MESSAGES:
                groups.append(F.transform(items, lambda t: _turn(t["role"], t["content"])))
            else:
                groups.append(F.flatten(F.transform(items, lambda e: F.array(_turn(F.lit("user"), F.get(e, F.lit(0))), _turn(F.lit("assistant"), F.get(e, F.lit(1)))))))
            continue
        if any(isinstance(k, (T.ArrayType, T.StructType)) for k in kinds):
            return None
        texts = [v.cast("string") for v in value]
        text = texts[0] if len(texts) == 1 else F.array_join(F.filter(F.array(*texts), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")
        groups.append(F.filter(F.array(_turn(F.lit(role), text)), lambda t: (t["role"] != "system") | (t["text"] != "")))
    return F.concat(none, *[F.coalesce(g, none) for g in groups])


def _of_list(record: Column, m: Mapping, schema: T.StructType | None) -> Column | None:
    if m.turns:
        if schema:
            if m.parts:
                return _listed_turns(record[m.turns], m, lambda t: F.array_join(F.transform(t[m.text], lambda p: F.coalesce(p["text"], F.lit(""))), ""))
            if not isinstance(_has(schema, f"{m.turns}[].{m.text}"), T.StringType):
                return None
            return _listed_turns(record[m.turns], m, lambda t: t[m.text])
        kind = f"struct<`{m.turns}`:array<struct<`{m.role}`:string,`{m.text}`:string>>>"
        return _listed_turns(F.from_json(record, kind)[m.turns], m, lambda t: _texts_of_parts(t[m.text]) if m.parts else t[m.text])
    return None


def _lists(mappings: tuple[Mapping, ...]) -> tuple[Mapping, ...]:
    return tuple(m for m in mappings if m.turns)


def schema_fingerprints(paths: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> tuple[Column, Column]:
    """By all names that mappings have, and, for lists of turns beside fields of other layouts, by those that such lists have."""
    return schema_fingerprint(F.lit(None), None, mappings, paths), schema_fingerprint(F.lit(None), None, _lists(mappings), paths)


def canonical_turns(
    record: Column, mappings: tuple[Mapping, ...] = MAPPINGS, schema: T.StructType | None = None, fingerprints: tuple[Column, Column] | None = None
) -> tuple[Column, Column]:
    """(layout, turns) of a record: the mapping's name, and array<struct<role, text>>. With a ``schema`` the record is a struct, else JSON text.

    ``fingerprints`` are those of ``schema_fingerprints``, best as columns of their own, as each mapping looks at them.
    """
    if fingerprints is None:
        fingerprints = schema_fingerprints(struct_paths(record, schema, mappings=mappings) if schema else field_paths(record, mappings=mappings), mappings)
    whole, lists = fingerprints
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        found = _mapped(record, m, schema)
        if found is not None:
            fits = whole.isin(*m.fingerprints)
            if m.turns:
                fits |= lists.isin(*m.fingerprints)
            layout, turns = F.when(fits, F.lit(m.name)).otherwise(layout), F.when(fits, found).otherwise(turns)
    return layout, turns


def unread_fields(paths: Column, layout: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The names of a record's outermost fields that no turn was made of, in order."""
    used = F.array().cast("array<string>")
    for m in mappings:
        used = F.when(layout == m.name, F.array(*[F.lit(f) for f in sorted(m.fields)])).otherwise(used)
    outer = F.filter(paths, lambda p: ~p.contains(".") & ~p.endswith("[]") & ~p.endswith("{}"))
    return F.array_sort(F.array_except(outer, used))


def records_of_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, record): a table with a row for each turn as records of the layout "turns"."""
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    listed = rows.groupBy(F.col(id_col).alias(id_col)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    kept = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return listed.select(id_col, F.struct(kept.alias("conversation")).alias("record"))


def format_turns(turns: Column) -> Column:
    """One text, by the template."""

    def marked(t: Column) -> Column:
        out = F.concat(F.lit(OTHER[0]), escape(t["role"]), F.lit(OTHER[1]), escape(t["text"]), F.lit(OTHER[2]))
        for role, (a, b) in MARKS.items():
            out = F.when(t["role"] == role, F.concat(F.lit(a), escape(t["text"]), F.lit(b))).otherwise(out)
        return out

    return F.array_join(F.transform(turns, marked), "")


#: One turn of a formatted text: everything up to a closing control string; inside texts none stands unescaped.
TURN = r"(?s)(?:\[INST\]|\[SYS\]|<s>|\[ROLE\]).*?(?:\[/INST\]|\[/SYS\]|</s>|\[/ROLE\])"


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text."""

    def read(t: Column) -> Column:
        out = F.lit(None).cast("struct<role:string,text:string>")
        inner = F.substr(t, F.lit(len(OTHER[0]) + 1), F.length(t) - len(OTHER[0]) - len(OTHER[2]))
        cut = F.instr(inner, OTHER[1])
        out = F.struct(
            unescape(F.substr(inner, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(inner, cut + len(OTHER[1]), F.length(inner))).alias("text")
        )
        for role, (a, b) in MARKS.items():
            text = F.substr(t, F.lit(len(a) + 1), F.length(t) - len(a) - len(b))
            out = F.when(F.startswith(t, F.lit(a)), F.struct(F.lit(role).alias("role"), unescape(text).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), read)


def loss_text(formatted: Column) -> Column:
    """All text under the loss mask: the assistant's, unescaped, in order."""
    return F.array_join(F.transform(F.filter(read_turns(formatted), lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def format_conversations(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``layout``, ``formatted`` (null for an unknown layout) and ``unread``."""
    kind, paths = records.schema[record_col].dataType, free_name(records, "paths")
    whole, lists = free_name(records, "fingerprint"), free_name(records, "fingerprint_of_lists")
    schema, record = kind if isinstance(kind, T.StructType) else None, F.col(record_col)
    found = records.withColumn(paths, struct_paths(record, schema, mappings=mappings) if schema else field_paths(record, mappings=mappings))
    found = found.withColumns(dict(zip((whole, lists), schema_fingerprints(F.col(paths), mappings), strict=True)))
    layout, turns = canonical_turns(record, mappings, schema, (F.col(whole), F.col(lists)))
    found = found.withColumn("layout", layout).withColumn("formatted", format_turns(turns))
    return found.withColumn("unread", unread_fields(F.col(paths), F.col("layout"), mappings)).drop(paths, whole, lists)


def turn_digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the formatted text."""
    read = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )
