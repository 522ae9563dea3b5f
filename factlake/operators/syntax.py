"""Syntax of contract sources: functions, account structs, calls and assignments of a file, found with a small scanner.

Comments, strings and characters are blanked first, keeping every place, so that braces and names can be found by patterns. The
scanner runs file by file; a file that can't be read gives a row with its error and nothing else."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import split_outside

# a sight of the first character comes first, as most places can begin nothing
_SPECIAL = re.compile(r"""(?=[/br"'])(?://|/\*|\bb?r(\#*)"|b?"|b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^'\\])')""", re.S)
_OPENS, _CLOSES = "([{", ")]}"
_FUNCTION = re.compile(r"(?=[paucf])(?:\b(pub)(\s*\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*\bfn\s+(\w+)")
_STRUCT = re.compile(r"(?=[#ps])((?:#\[[^\n]*\]\s*)*)(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)[^{;(]*\{")
# what is repeated is given up whole (possessive): no shorter run could be followed by what has to follow; nor does a call begin inside a
# word unless it begins with the word
_CALL = re.compile(r"(?=[\w>)\]])(?:(?<![A-Za-z_])|(?=[>)\]]))((?:[\w>)\]]\s*+\.\s*+)?[A-Za-z_]\w*+(?:\s*+(?:::|\.)\s*+(?:<[^<>()]*+>\s*+)?[A-Za-z_]\w*+)*+)\s*+\(")
_MACRO = re.compile(r"\b(\w++)!\s*+[(\[{]")
_WRITE = re.compile(r"(?:^|[;{}])\s*+([\w.\[\]&:*()]++)\s*+(?:[+\-*/|&^]|<<|>>)?+=(?![=>])", re.M)
_DEFINED = re.compile(r"\bfn\s+$")
_SIGN = re.compile(r"[,(<\[)>\]]")
_KEYWORDS = {"if", "while", "for", "match", "return", "fn", "loop", "let", "in", "as", "move", "else", "mut", "ref", "pub", "where", "impl", "struct", "enum"}
#: Macros that are worth a row of their own. Fixed values.
MACROS = ("require", "require_eq", "require_keys_eq", "require_gt", "require_gte", "require_neq", "require_keys_neq", "assert", "assert_eq", "msg", "emit", "declare_id")

INSTRUCTION = "struct<name:string,line:int,end_line:int,params:string,context:string,calls:array<string>,body:string,excerpt:string>"
FIELD = "struct<name:string,type:string,line:int,end_line:int,attributes:array<string>>"
STRUCT = f"struct<name:string,line:int,end_line:int,accounts:boolean,state:boolean,fields:array<{FIELD}>>"
NODE = "struct<kind:string,function:string,text:string,target:string,line:int,end_line:int,aliased:boolean>"
ITEM = "struct<kind:string,name:string,value:string,line:int>"
FILE = "repo_id string, path string, n_lines int, digest string, framework string, error string"
PARSED = f"{FILE}, instructions array<{INSTRUCTION}>, structs array<{STRUCT}>, nodes array<{NODE}>, items array<{ITEM}>"


def blanked(text: str) -> str:
    """The text with comments, strings and characters turned to spaces; line ends stay. Lifetimes aren't characters."""
    out, at = [], 0

    def blank(part: str) -> str:
        return "\n".join(" " * len(row) for row in part.split("\n"))

    while m := _SPECIAL.search(text, at):
        out.append(text[at : m.start()])
        token = m[0]
        if token == "//":
            end = text.find("\n", m.end())
        elif token == "/*":
            depth, end = 1, m.end()
            while depth and (n := re.compile(r"/\*|\*/").search(text, end)):
                depth += 1 if n[0] == "/*" else -1
                end = n.end()
            end = -1 if depth else end
        elif m[1] is not None:
            end = text.find('"' + m[1], m.end())
            end = end + 1 + len(m[1]) if end >= 0 else -1
        elif token.endswith('"'):
            n = re.compile(r'(?:\\.|[^"\\])*"', re.S).match(text, m.end())
            end = n.end() if n else -1
        else:
            end = m.end()
        end = len(text) if end < 0 else end
        out.append(blank(text[m.start() : end]))
        at = end
    return "".join([*out, text[at:]])


def pairs(text: str) -> dict[int, int]:
    """Where each bracket that opens is closed; unmatched ones are left out."""
    stack, out = [], {}
    for m in re.finditer(r"[()\[\]{}]", text):
        c = m[0]
        if c in _OPENS:
            stack.append((c, m.start()))
        elif stack and _OPENS.index(stack[-1][0]) == _CLOSES.index(c):
            out[stack.pop()[1]] = m.start()
    return out


class Source:
    def __init__(self, text: str):
        self.text, self.bare = text, blanked(text)
        self.close = pairs(self.bare)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def functions(self) -> list[tuple[str, bool, int, int, int, int]]:
        """(name, exactly pub, begin, parameters begin, body begin, body end) of functions with a body."""
        out = []
        for m in _FUNCTION.finditer(self.bare):
            paren = self.bare.find("(", m.end())
            if paren < 0 or paren not in self.close:
                continue
            after = re.compile(r"[;{]").search(self.bare, self.close[paren])
            if after and after[0] == "{" and after.start() in self.close:
                out.append((m[3], bool(m[1]) and not m[2], m.start(), paren, after.start(), self.close[after.start()]))
        return out

    def module(self) -> tuple[int, int] | None:
        m = re.search(r"#\[program\][^{;]*\bmod\s+\w+\s*\{", self.bare)
        return (m.end() - 1, self.close[m.end() - 1]) if m and m.end() - 1 in self.close else None


def _excerpt(text: str, most: int = 60) -> str:
    rows = text.split("\n")
    return "\n".join(rows[:most]) + ("\n// ... cut" if len(rows) > most else "")


def _instructions(s: Source, functions) -> list[dict]:
    module, out = s.module(), []
    own = [f for f in functions if module and f[1] and module[0] < f[2] < module[1]]
    for name, _, begin, paren, body, end in own or [f for f in functions if re.match(r"(process|handle)_", f[0])]:
        params = s.text[paren + 1 : s.close[paren]]
        context = re.findall(r"Context<\s*(\w+)\s*>", params)
        parts = [re.sub(r"\s+", " ", p).strip() for p in re.split(r",(?![^<(]*[>)])", params)]
        kept = [p for p in parts if p and not re.match(r"(mut\s+)?_?ctx\b", p)]
        calls = dict.fromkeys(x for m in _CALL.finditer(s.bare, body, end) if (x := re.sub(r"\s+", "", m[1])) not in _KEYWORDS and len(x) < 80)
        text = s.text[begin : end + 1]
        out.append({"name": name, "line": s.line(begin), "end_line": s.line(end), "params": ", ".join(kept), "context": context[0] if context else None, "calls": list(calls), "body": text, "excerpt": _excerpt(text)})
    return out


def _fields(s: Source, begin: int, end: int) -> list[dict]:
    out, attributes, at = [], [], begin + 1
    for m in re.compile(r"#\[|(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:(?!:)").finditer(s.bare, begin + 1, end):
        if m.start() < at:
            continue
        if m[0] == "#[":
            close = s.close.get(m.end() - 1, end)
            inner = re.match(r"account\s*\(", s.text[m.end() : close])
            if inner:
                attributes.append(s.text[m.end() + inner.end() : s.text.rfind(")", m.end(), close)])
            at = close
            continue
        depth, k = 0, end
        for sign in _SIGN.finditer(s.bare, m.end(), end):
            if sign[0] == "," and depth <= 0:
                k = sign.start()
                break
            depth += (sign[0] in "(<[") - (sign[0] in ")>]")
        out.append({"name": m[1], "type": re.sub(r"\s+", " ", s.text[m.end() : k]).strip(), "line": s.line(m.start()), "end_line": s.line(m.start() + len(s.text[m.start() : k].rstrip()) - 1), "attributes": attributes})
        attributes, at = [], k
    return out


def _structs(s: Source) -> list[dict]:
    out = []
    for m in _STRUCT.finditer(s.bare):
        head, begin = s.text[m.start() : m.end()], m.end() - 1
        accounts, state = bool(re.search(r"derive\([^)]*\bAccounts\b", head)), bool(re.search(r"#\[account\b", head))
        if (accounts or state) and begin in s.close:
            out.append({"name": m[2], "line": s.line(m.start(2)), "end_line": s.line(s.close[begin]), "accounts": accounts, "state": state, "fields": _fields(s, begin, s.close[begin])})
    return out


def _nodes(s: Source, functions) -> list[dict]:
    """Calls and assignments; what stands in a macro's brackets is no call."""
    hidden = [(m.end() - 1, s.close[m.end() - 1]) for m in _MACRO.finditer(s.bare) if m.end() - 1 in s.close]
    hidden += [(m.end() - 1, s.close[m.end() - 1]) for m in re.finditer(r"#!?\[", s.bare) if m.end() - 1 in s.close]

    bodies = [(f[4], f[5], f[0], "&mut ctx.accounts." in s.text[f[4] : f[5]]) for f in functions]

    def owner(at: int) -> tuple[str, bool]:
        own = [f for f in bodies if f[0] < at < f[1]]
        return max(own, key=lambda f: f[0])[2:] if own else ("unknown", False)

    out = []
    for m in _CALL.finditer(s.bare):
        paren = m.end() - 1
        name = "".join(m[1].split())
        if name in _KEYWORDS or paren not in s.close or _DEFINED.search(s.bare[max(0, m.start() - 6) : m.start()]) or any(a < m.start() < b for a, b in hidden):
            continue
        function, aliased = owner(m.start())
        out.append({"kind": "call", "function": function, "text": s.text[m.start() : s.close[paren] + 1], "target": name, "line": s.line(m.start()), "end_line": s.line(s.close[paren]), "aliased": aliased})
    for m in _WRITE.finditer(s.bare):
        at, written = m.start(1), m[1]
        if written[-1] in "*&" and s.bare[m.end(1)] == "=" and len(written.lstrip("*")) > 1:
            written = written[:-1]  # the sign of *= or &=
        function, aliased = owner(at)
        if function == "unknown" or any(a < at < b for a, b in hidden) or re.match(r"(let|const|static|type)\b", written):
            continue
        end = s.bare.find(";", m.end())
        end = len(s.text) if end < 0 else end
        out.append({"kind": "write", "function": function, "text": s.text[at:end], "target": written, "line": s.line(at), "end_line": s.line(end), "aliased": aliased})
    return sorted(out, key=lambda n: (n["line"], n["kind"]))


def _items(s: Source) -> list[dict]:
    out = [{"kind": "macro", "name": m[1], "value": s.text[m.end() : s.close[m.end() - 1]][:200], "line": s.line(m.start())} for m in _MACRO.finditer(s.bare) if m[1] in MACROS and m.end() - 1 in s.close]
    out += [{"kind": "constant", "name": m[1], "value": s.text[m.end() : s.bare.find(";", m.end())].strip()[:200], "line": s.line(m.start())} for m in re.finditer(r"\bconst\s+(\w+)\s*:[^=;]*=", s.bare)]
    for m in re.finditer(r"\benum\s+(\w+)[^{;]*\{", s.bare):
        if m.end() - 1 in s.close and re.search(r"State|Status|Phase|Stage", m[1]):
            body = s.bare[m.end() : s.close[m.end() - 1]]
            out.append({"kind": "state_enum", "name": m[1], "value": ",".join(re.findall(r"(?:^|,)\s*(\w+)", re.sub(r"\([^)]*\)|\{[^}]*\}|#\[[^\]]*\]", "", body))), "line": s.line(m.start())})
    return out


#: What a file is read for; each is a column of parsed rows.
PARTS = ("instructions", "structs", "nodes", "items")


def parse_file(content: str, parts: tuple[str, ...] = PARTS) -> dict:
    s = Source(content)
    functions = s.functions()
    framework = "anchor" if "#[program]" in s.bare or "anchor_lang" in s.bare else "native" if re.search(r"entrypoint!|process_instruction", s.bare) else "unknown"
    return {"n_lines": content.count("\n") + 1, "digest": hashlib.sha256(content.encode()).hexdigest()[:16], "framework": framework, "error": None, **{x: _READERS[x](s, functions) if x in parts else [] for x in PARTS}}


_READERS = {"instructions": _instructions, "structs": lambda s, _: _structs(s), "nodes": _nodes, "items": lambda s, _: _items(s)}


def parse(files: DataFrame, *parts: str) -> DataFrame:
    """One row a file (see PARSED). Null content counts as empty. Of `parts` (see PARTS; none means all) the others stay empty arrays, and
    cost nothing. A file is read in the task that holds it, so a table that comes in few partitions should be spread before."""
    wanted = parts or PARTS
    if unknown := set(wanted) - set(PARTS):
        raise ValueError(f"no parts of a file: {sorted(unknown)}")
    return _read(files, wanted, PARSED, ("repo_id", "path", "n_lines", "digest", "framework", "error", *PARTS))


def read_files(files: DataFrame) -> DataFrame:
    """The rows of parse without the columns of the parts (see FILE). Every part of a file is read all the same, as one that can't be
    read is the file's error; what was found is dropped where it was found, and not made into columns."""
    return _read(files, PARTS, FILE, ("repo_id", "path", "n_lines", "digest", "framework", "error"))


def _read(files: DataFrame, wanted: tuple[str, ...], schema: str, names: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterable[pd.DataFrame]):
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                try:
                    row = {"repo_id": f.repo_id, "path": f.path, **parse_file(f.content or "", wanted)}
                except Exception as e:  # one odd file must not stop the others; its row says why
                    row = {"repo_id": f.repo_id, "path": f.path, "n_lines": 0, "digest": None, "framework": "unknown", "error": repr(e)[:200], "instructions": [], "structs": [], "nodes": [], "items": []}
                rows.append(tuple(row[x] for x in names))
            yield pd.DataFrame(rows, columns=list(names))

    return files.select("repo_id", "path", "content").mapInPandas(run, schema)


# ---- columns over parsed rows ----------------------------------------------------------------------------


def exploded(parsed: DataFrame, column: str) -> DataFrame:
    rows = parsed.select("repo_id", "path", F.posexplode(column).alias("n", "x"))
    return rows.select("repo_id", "path", "x.*", F.concat_ws(":", "path", F.lpad(F.col("n").cast("string"), 6, "0")).alias("ord"))


_PLAIN = ("mut", "signer", "init", "init_if_needed", "zero", "executable", "bump")
#: Left side of an account constraint and the kind that it has. Fixed values.
_KINDS = {
    "payer": "payer", "space": "space", "close": "close", "has_one": "has_one", "address": "address", "owner": "owner", "bump": "bump", "constraint": "constraint", "seeds": "seeds", "realloc": "realloc",
    "token::authority": "token_authority", "token::mint": "token_mint", "associated_token::authority": "associated_token_authority", "associated_token::mint": "associated_token_mint",
}


def constraints(text: Column | str) -> Column:
    """Array of (kind, expression) of a constraint list."""

    def one(p: Column) -> Column:
        key, value = F.regexp_extract(p, r"^([\w:]+)\s*=\s*(?s:(.+))$", 1), F.regexp_extract(p, r"^([\w:]+)\s*=\s*(?s:(.+))$", 2)
        kind = F.when(p.isin(*_PLAIN), p).when(p.isin("rent_exempt = skip", "rent_exempt = enforce"), "rent_exempt")
        for left, name in _KINDS.items():
            kind = kind.when(key == left, name)
        kind = kind.otherwise("raw")
        return F.struct(kind.alias("kind"), F.when(p.isin(*_PLAIN), F.lit(None).cast("string")).when(kind.isin("raw", "rent_exempt"), p).otherwise(F.trim(value)).alias("expression"))

    return F.transform(split_outside(text), one)


def account_type(type_: Column) -> tuple[Column, Column]:
    """Kind of account and inner type, Box and Option taken off."""
    bare = F.regexp_replace(F.regexp_replace(type_, r"^Box<(.+)>$", "$1"), r"^Option<(.+)>$", "$1")
    kind = F.regexp_extract(bare, r"^(Signer|Program|SystemAccount|UncheckedAccount|AccountInfo|AccountLoader|InterfaceAccount|Interface|Account)<", 1)
    return F.when(kind == "", "other").otherwise(kind), F.nullif(F.regexp_extract(bare, r"<'?\w*,?\s*(\w+)>", 1), F.lit(""))


def account_fields(parsed: DataFrame) -> DataFrame:
    """A row for each field: struct, struct_ord, accounts, name, type, kind, inner, constraints, is_signer, is_mut, line, end_line."""
    rows = exploded(parsed, "structs")
    rows = rows.select("repo_id", "path", F.col("name").alias("struct"), F.col("ord").alias("struct_ord"), "accounts", F.posexplode("fields").alias("n", "f"))
    kind, inner = account_type(F.col("f.type"))
    found = F.flatten(F.transform("f.attributes", lambda a: constraints(a)))
    rows = rows.select("repo_id", "path", "struct", "struct_ord", "accounts", "n", F.col("f.name").alias("name"), F.col("f.type").alias("type"), F.col("f.line").alias("line"), F.col("f.end_line").alias("end_line"), kind.alias("kind"), inner.alias("inner"), found.alias("constraints"))

    def has(*kinds: str) -> Column:
        return F.exists("constraints", lambda x: x["kind"].isin(*kinds))

    return rows.withColumn("is_signer", (F.col("kind") == "Signer") | has("signer")).withColumn("is_mut", has("mut", "init", "init_if_needed"))


#: Kinds of value-moving operations with their signs, in the order in which they are tried. Fixed values.
SINKS = [
    ("token_transfer", r"token::transfer|transfer_checked|spl_token.*Transfer"), ("token_mint_to", r"mint_to|MintTo"), ("token_burn", r"token::burn|Burn"),
    ("sol_transfer", r"system_program::transfer|system_instruction::transfer|\*\*.*\.lamports\.borrow_mut\(\)|\.try_borrow_mut_lamports"), ("account_close", r"close_account|\.close\s*\(|lamports.*=\s*0"),
    ("set_authority", r"set_authority|SetAuthority"), ("oracle_read", r"price_feed|get_price|switchboard|(?i:pyth)|(?i:oracle)|AggregatorAccountData"), ("invoke_signed", r"invoke_signed\s*\(|CpiContext::new_with_signer"), ("realloc", r"\.realloc\s*\(|realloc\s*="),
]


def sinks(parsed: DataFrame) -> DataFrame:
    """Value-moving operations: kind, instruction, accounts, excerpt, line, end_line. A node has the first kind whose sign it shows; other
    assignments write state if they go to an account of the context."""
    rows, text = exploded(parsed, "nodes"), F.col("text")
    kind = F.when(text.rlike(SINKS[0][1]), SINKS[0][0])
    for name, sign in SINKS[1:]:
        kind = kind.when(text.rlike(sign), name)
    kind = kind.when((F.col("kind") == "write") & (F.col("target").contains("ctx.accounts.") | (F.col("aliased") & F.col("target").contains("."))), "state_write")
    accounts = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"ctx\.accounts\.(\w+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(\w+)\.to_account_info\(\)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(\w+)\.key\(\)"), F.lit(1))))
    return rows.select("repo_id", "path", kind.alias("sink"), F.col("function").alias("instruction"), accounts.alias("accounts"), F.substring(text, 1, 500).alias("excerpt"), "line", "end_line", "ord").where(F.col("sink").isNotNull())


def calls(parsed: DataFrame) -> DataFrame:
    """Calls of other programs: call_type, target, validated."""
    rows, text = exploded(parsed, "nodes").where("kind = 'call'"), F.col("text")
    kind = F.when(text.rlike(r"invoke_signed\s*\("), "invoke_signed").when(text.rlike(r"invoke\s*\("), "invoke").when(text.contains("CpiContext::new_with_signer"), "CpiContext::new_with_signer").when(text.rlike(r"CpiContext::new\b"), "CpiContext::new").when(text.rlike(r"token::\w+"), "token::*").when(text.rlike(r"system_program::\w+"), "system_program::*")
    first = F.regexp_extract(text, r"invoke(?:_signed)?\s*\(\s*&?([^,]+)", 1)
    target = F.substring(F.trim(F.when(first != "", first).otherwise(F.regexp_extract(text, r"CpiContext::new(?:_with_signer)?\s*\(\s*([^,]+)", 1))), 1, 80)
    rows = rows.withColumn("call_type", kind).where(F.col("call_type").isNotNull())
    valid = text.contains("Program<") | text.contains("token_program") | F.col("call_type").isin("token::*", "system_program::*")
    return rows.select("repo_id", "path", "call_type", target.alias("target"), valid.alias("validated"), F.col("function").alias("instruction"), F.substring(text, 1, 500).alias("excerpt"), "line", "end_line", "ord")


def derivations(parsed: DataFrame) -> DataFrame:
    """Derived addresses, of calls (source inline) and of fields (source constraint; a bump without expression counts as missing).
    parsed is read twice, so it should be written."""
    rows, text = exploded(parsed, "nodes").where("kind = 'call'"), F.col("text")
    seeds = split_outside(F.regexp_extract(text, r"&\[([^\]]+)\]", 1))
    bumps = F.filter(F.array(F.when(text.contains("find_program_address"), "canonical"), F.when(text.contains("create_program_address"), "unchecked")), lambda x: x.isNotNull())  # a text may hold both
    inline = rows.where(F.size(bumps) > 0).select("repo_id", "path", seeds.alias("seeds"), F.explode(bumps).alias("bump"), F.lit("inline").alias("source"), F.col("function").alias("instruction"), F.substring(text, 1, 500).alias("excerpt"), "line", "end_line", "ord")
    fields = account_fields(parsed).where(F.exists("constraints", lambda x: x["kind"] == "seeds"))
    listed = F.try_element_at(F.filter("constraints", lambda x: x["kind"] == "seeds"), F.lit(1))["expression"]
    bump = F.when(F.exists("constraints", lambda x: (x["kind"] == "bump") & x["expression"].isNotNull()), "canonical").otherwise("missing")
    declared = fields.select("repo_id", "path", split_outside(F.regexp_replace(listed, r"^\[|\]$", "")).alias("seeds"), bump.alias("bump"), F.lit("constraint").alias("source"), F.col("struct").alias("instruction"), F.lit("").alias("excerpt"), "line", F.col("line").alias("end_line"), F.concat_ws(":", "struct_ord", F.lpad(F.col("n").cast("string"), 4, "0")).alias("ord"))
    return declared.unionByName(inline)
