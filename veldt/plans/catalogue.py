"""Rule catalogues: JSON to rules, policies and ignore rules, checked and flattened before any plan is made.

A file holds an object or a list; comments, trailing commas and any case of names are accepted. Objects are told apart by
their properties: `matchTarget` makes an ignore rule, `matches` a rule (detector and policy in one), `patterns` or `label` an
older detector, anything else an older policy that names detectors. A folder replaces the bundled rules; one that has ignore
rules alone adds to them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

TARGETS = ("Content", "FileName", "FileExtension", "DirectoryName", "DirectoryPath", "ShareName")
SEVERITIES = ("Info", "Informational", "Low", "Medium", "High", "Critical")
#: Extensions of documents whose text is extracted, and of text that may hold source or configuration.
DOCUMENTS = frozenset(".pdf .doc .docx .docm .dot .dotx .dotm .xls .xlsx .xlsm .xlsb .xlt .xltx .xltm .ppt .pptx .pptm .pps .ppsx .ppsm .pot .potx .potm .one .onepkg .png .jpg .jpeg .tif .tiff .bmp .gif .webp".split())
SOURCE_AND_CONFIG = (
    frozenset(
        ".ascx .ashx .asmx .asp .aspx .bash_history .bashrc .bat .bicep .bicepparam .c .cc .cfm .cjs .cmd .cnf .conf .config .cpp .credentials .cs .cshtml .csv .cue .cxx "
        ".dart .dist .do .dockerfile .dockerignore .docx .editorconfig .env .es .es6 .exports .extra .fdb .fs .fsx .fx .functions .gemrc .git-credentials .gitconfig .go .gql "
        ".gradle .graphql .groovy .h .har .hcl .hpp .hta .http .inc .inf .ini .irb_history .ipynb .java .js .json .jsonl .jsp .jsx .key .kt .kts .log .ls .lua .markdown .md "
        ".mdc .mjs .ndjson .netrc .nix .npmrc .nuget .pdf .pem .php .php3 .php5 .php7 .phtml .pl .profile .prompt .prompty .properties .ps1 .psd1 .psm1 .pub .py .pypirc "
        ".proto .r .rb .rc .rego .rest .rs .scala .service .sh .sh_history .sql .sqlite .sqlite3 .svelte .swift .targets .templ .tf .tfplan .tfrc .tfstate .tfvars .toml .ts "
        ".tsv .tsx .txt .vb .vbe .vbs .vue .wsc .wsf .xlsx .xml .yaml .yml .zsh_history .zshrc".split()
    )
    | DOCUMENTS
    | {""}
)
PROFILES = {"documents": DOCUMENTS, "sourceandconfig": SOURCE_AND_CONFIG}
BUNDLED = Path(__file__).parent.parent / "rules"


class CatalogueError(ValueError):
    """A rule file that can't be used as it is."""


@dataclass(frozen=True)
class Match:
    target: str
    patterns: tuple[str, ...]
    literal: bool = False
    case_sensitive: bool = False
    keywords: tuple[str, ...] = ()
    profile: str = ""
    extensions: tuple[str, ...] = ()

    def scope(self) -> frozenset[str]:
        """The extensions that the block names, with a leading dot, in lower case."""
        own = {("." + e.lstrip("*").lstrip(".")).lower() if e.strip("*.") else "" for e in self.extensions}
        return frozenset(own) | PROFILES.get(self.profile.strip().lower(), frozenset())

    def regex(self) -> str:
        """One alternation of the block's patterns with its case; flags that a pattern starts with hold for that pattern."""
        flag = "(?-i:{})" if self.case_sensitive else "(?i:{})"
        scoped = lambda p: re.sub(r"^\(\?([a-z]+)\)(.*)$", r"(?\1:\2)", p, flags=re.S)
        return "|".join(flag.format(re.escape(p) if self.literal else scoped(p)) for p in self.patterns)


def compiled(pattern: str):
    """A pattern for Python's `re`, or for `regex` where it has what only that knows (look-behind of any width)."""
    try:
        return re.compile(pattern)
    except re.error:
        try:
            import regex

            return regex.compile(pattern)
        except ImportError:
            raise re.error(f"needs the package regex: {pattern}") from None
        except regex.error as e:
            raise re.error(str(e)) from e


@dataclass(frozen=True)
class Rule:
    name: str
    matches: tuple[Match, ...]
    severity: str = "Medium"
    enabled: bool = True
    report: bool = True
    finding_name: str = ""
    description: str = ""
    validator: str = ""
    entropy: float = 0.0
    llm: bool = True
    min_match: int = 1
    stop: bool = False
    include_paths: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    children: tuple[Rule, ...] = ()
    parent: str = ""
    #: The group that holds the value, by name or number; the whole match where it is empty or took no part.
    value_group: str = ""

    def content(self) -> tuple[Match, ...]:
        return tuple(m for m in self.matches if m.target == "Content")

    def keywords(self) -> list[tuple[str, bool]]:
        """Keywords and whether case counts, pooled over the rule's content blocks."""
        return list(dict.fromkeys((k, m.case_sensitive) for m in self.content() for k in m.keywords))

    def scope(self) -> frozenset[str]:
        """Extensions pooled over all blocks; none means any."""
        return frozenset().union(*(m.scope() for m in self.matches)) if self.matches else frozenset()


@dataclass(frozen=True)
class Policy:
    """What reports a detector's matches."""

    name: str
    classifiers: tuple[str, ...]
    active: bool = True
    severity: str = "Medium"
    report_only: bool = False
    min_match: int = 1
    stop: bool = False
    include_paths: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    target: str = "FileName"
    description: str = ""
    enabled: bool = True


@dataclass
class Catalogue:
    rules: list[Rule] = field(default_factory=list)
    policies: list[Policy] = field(default_factory=list)
    ignore: list[IgnoreRule] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def flat(self) -> list[Rule]:
        """Rules and their children, each child with its parent's name, in order."""

        def walk(rules: Iterable[Rule], parent: str) -> Iterator[Rule]:
            for r in rules:
                yield replace(r, parent=parent)
                yield from walk(r.children, r.name)

        return list(walk(self.rules, ""))

    def reporting(self) -> list[Policy]:
        """The active policies: those that rules imply, and older ones; names that repeat keep the first."""
        own = [Policy(r.finding_name or r.name, (r.name,), r.enabled and r.report, r.severity, False, r.min_match, r.stop, r.include_paths, r.exclude_paths, r.description) for r in self.flat()]
        kept: dict[str, Policy] = {}
        for p in [*own, *self.policies]:
            kept.setdefault(p.name, p)
        return [p for p in kept.values() if p.active]

    def missing(self) -> list[str]:
        """Detectors that policies name and the catalogue hasn't."""
        known = {r.name for r in self.flat()}
        return sorted({c for p in self.policies for c in p.classifiers} - known)


def _plain_json(text: str) -> Any:
    """JSON with // and /* */ comments and trailing commas; strings stay as they are."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|,(?=\s*(?://[^\n]*\s*|/\*.*?\*/\s*)*[}\]])', re.S)
    return json.loads(token.sub(lambda m: m[0] if m[0][0] == '"' else "", text))


def _decode(data: bytes) -> str:
    """Strict UTF-8, or UTF-16/32 by its mark."""
    for mark, name in ((b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name)
    return data.decode("utf-8-sig")


def _low(value: Any) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise CatalogueError("a rule must be an object")
    return {k.lower(): v for k, v in value.items() if v is not None}


def _match(value: Any) -> Match:
    d = _low(value)
    target = next((t for t in TARGETS if t.lower() == str(d.get("target", "Content")).lower()), None)
    if target is None:
        raise CatalogueError(f"unknown target {d.get('target')!r}")
    return Match(target, tuple(d.get("patterns", ())), bool(d.get("isliteral")), bool(d.get("casesensitive")), tuple(d.get("keywords", ())), d.get("extensionprofile", ""), tuple(d.get("includedextensions", ())))


def _severity(value: Any) -> str:
    found = next((s for s in SEVERITIES if s.lower() == str(value).lower()), None)
    if found is None:
        raise CatalogueError(f"unknown severity {value!r}")
    return found


def _rule(value: Any) -> Rule:
    d = _low(value)
    return Rule(
        d.get("name", ""), tuple(map(_match, d.get("matches", ()))), _severity(d.get("severity", "Medium")), bool(d.get("enabled", True)), bool(d.get("reportfinding", True)), d.get("findingname", ""), d.get("description", ""), d.get("validator", ""),
        float(d.get("entropythreshold", 0)), bool(d.get("enablellmvalidation", True)), int(d.get("minmatchcount", 1)), bool(d.get("stoponmatch")), tuple(d.get("includepaths", ())), tuple(d.get("excludepaths", ())), tuple(map(_rule, d.get("subrules", ()))),
    )


def _older_detector(d: dict[str, Any]) -> Rule:
    """A detector without policy: it reports only where a policy names it."""
    blocks = tuple(map(_match, d["matches"])) if "matches" in d else (_match(d),)
    return Rule(d.get("name", ""), blocks, enabled=bool(d.get("isenabled", True)), report=False, validator=d.get("validator", ""), entropy=float(d.get("entropythreshold", 0)))


def _older_policy(d: dict[str, Any]) -> Policy:
    c = _low(d.get("configuration", {}))
    return Policy(d.get("name", ""), tuple(d.get("classifiernames", ())), bool(d.get("active", True)), _severity(d.get("severity", "Medium")), bool(d.get("isreportonly")), int(c.get("minmatchcount", 1)), bool(d.get("stoponmatch")), tuple(c.get("includepaths", ())), tuple(c.get("excludepaths", ())), d.get("description", ""))


def parse(text: str, into: Catalogue) -> None:
    """Adds a file's objects to a catalogue."""
    found = _plain_json(text)
    for value in found if isinstance(found, list) else [found]:
        d = _low(value)
        if "matchtarget" in d:
            target = next((t for t in TARGETS if t.lower() == str(d["matchtarget"]).lower()), None)
            if target is None or not d.get("pattern"):
                raise CatalogueError(f"an ignore rule needs a pattern and a known target: {value}")
            into.ignore.append(IgnoreRule(d["pattern"], target, d.get("description", ""), bool(d.get("isenabled", d.get("enabled", True)))))
        elif "patterns" in d or "label" in d:
            into.rules.append(_older_detector(d))
        elif "matches" in d or "subrules" in d:
            into.rules.append(_rule(value))
        else:
            into.policies.append(_older_policy(d))


def problems(rule: Rule, validators: Iterable[str], top: bool = True) -> list[str]:
    """What keeps a rule from use."""
    known = {v.lower() for v in validators}
    out = [] if rule.name.strip() else ["it has no name"]
    if not rule.matches:
        out.append("it has no match blocks")
    if rule.validator and rule.validator.lower() not in known:
        out.append(f"its validator {rule.validator} is unknown")
    if rule.min_match < 1:
        out.append("its least number of matches is below 1")
    for m in rule.matches:
        if not m.patterns or not all(p.strip() for p in m.patterns):
            out.append(f"its {m.target} block has no or empty patterns")
        if m.profile.strip() and m.profile.strip().lower() not in PROFILES:
            out.append(f"its extension profile {m.profile} is unknown")
        if top and m.target == "Content" and not m.scope():
            out.append("its content block names no extensions")
        try:
            compiled(m.regex())
        except re.error as e:
            out.append(f"a pattern doesn't compile: {e}")
    for child in rule.children:
        out += [f"{child.name}: {p}" for p in problems(child, validators, False)]
    return out


def _files(folder: Path) -> list[Path]:
    return sorted(p for p in folder.rglob("*") if p.suffix.lower() == ".json")


def load(folder: str | Path | None = None, validators: Iterable[str] | None = None) -> Catalogue:
    """The bundled catalogue, or that of a folder. Rules that can't be used are left out with a warning; a file that can't
    be read is an error, and so are two rules of one name."""
    from veldt.functions.validators import VALIDATORS

    out = Catalogue()
    for path in _files(Path(folder) if folder else BUNDLED):
        try:
            parse(_decode(path.read_bytes()), out)
        except (ValueError, UnicodeError) as e:
            raise CatalogueError(f"{path}: {e}") from e
    if folder and out.ignore and not out.rules and not out.policies:
        bundled = load(None, validators)
        return Catalogue(bundled.rules, bundled.policies, bundled.ignore + out.ignore, bundled.warnings)
    names = [r.name for r in out.flat()]
    if twice := {n for n in names if names.count(n) > 1}:
        raise CatalogueError(f"names that repeat: {sorted(twice)}")
    kept = []
    for rule in out.rules:
        if found := problems(rule, validators if validators is not None else VALIDATORS, top=rule.report or bool(rule.children)):
            out.warnings.append(f"{rule.name}: {'; '.join(found)}")
        else:
            kept.append(rule)
    return Catalogue(kept, out.policies, out.ignore, out.warnings)
