"""Secret scans: fixed patterns, and strings that no dictionary helps to compress."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.texts import in_pieces

# The patterns of the query's contract, in the order of their kinds.
# Those of access and hex ask for the least length at once, which finds the same
# matches: both run to the end of their characters.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_VALUE_CHARS = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

# Cheap test for texts that an assign match can be in.
_ASSIGN_STEMS = ("passw", "secret", "token", "apikey", "api_key")

# Words that make a string near them worth a look.
SENSITIVE = (
    "password passwd passphrase pwd secret token api_key apikey api-key access_key private_key "
    "client_secret credential authorization bearer signature session cookie salt"
).split()

# What identifiers and settings in code are made of. It primes the
# compressor, so that names cost few bytes and random strings many.
IDENTIFIERS = (
    "abstract access account action address admin api application args array async auth await base "
    "boolean bucket buffer build byte cache callback class client cluster code column command common "
    "config configuration connection const container content context controller cookie count create "
    "credential current data database date debug default delete description device directory document "
    "double element email enable encoding endpoint environment error event example exception execute "
    "export extends false field file filter float format function get group handler hash header host "
    "http https id image implements import index info init input instance int interface internal item "
    "key label length level library limit line link list loader local location log logger long main "
    "manager map master max memory message metadata method min mode model module name namespace native "
    "new node null number object offset option order output package page parameter parent parser "
    "password path payload placeholder plugin port prefix private process production profile project "
    "property protocol provider proxy public query queue random read record redirect ref region "
    "register release remote repository request resource response result return role root route row "
    "runtime sample schema scope script search secret security select server service session set "
    "setting shared signature size source stack start state static status storage store string struct "
    "suffix super system table tag target task template test thread time timeout timestamp title "
    "token trace transaction true type undefined update upload url user username util utils value "
    "variable version view void volume warning web window worker write your_password_here changeme "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 AbstractFactory BaseController "
    "ClassLoader ConnectionManager DefaultHandler EventListener HttpClient RequestHandler "
    "ResponseBuilder ServiceProvider UserRepository"
)

# Longer words of code and prose, so that names of plain words stay cheap
# although they hold no digit.
PLAIN_WORDS = (
    "ability accept across active adapter additional advance after again agent alert algorithm "
    "allocation allow alternative analysis annotation anonymous answer apache appearance approval "
    "architecture archive argument assembly assert assignment assistant associated attachment attempt "
    "attribute audience audit authenticated authentication Authentication AUTHENTICATION authenticator "
    "author authority authorization Authorization AUTHORIZATION authorize automatic availability "
    "available average backend BACKENDS backup balance bearer Bearer because before behavior benefit "
    "between binding block branch bridge browser building bundle business calendar callable "
    "capability capacity category certificate certificates challenge change channel character check "
    "choice cipher circle classification cleanup closed cloud collection combine comment commit "
    "communication community company comparison compatible compile complete component compress "
    "compute condition confirm connect consistent constant constraint consumer contact contract "
    "control conversation conversion convert coordinate core correct country coverage credentials "
    "Credentials critical current_user customer dashboard dataset decode decrypt DEFAULT define delegate deliver "
    "dependency deploy deployment description design desktop detail develop developer difference "
    "digest dimension disable discovery dispatcher display distribution document domain download "
    "driver duration dynamic economic edition editor education electric embedded emphasis employee "
    "empty encode encrypt encryption enforce engine enterprise entity entry enum environment epoch "
    "equal escape essential evaluate every evidence exchange exclude executor existing expected "
    "experience expire expiration expired explicit expression extension external factory Factory "
    "failed failure feature federation fetch figure final first folder following foreground forgot "
    "forward framework frequency friend future gateway general generator global government "
    "graphic grant_type guarantee guest hardware health hidden history holder Holder hostname however identifier "
    "identity image important include increase individual industry information inherit initialize "
    "inspector installation instruction integer integration intelligence interactive interceptor "
    "international internationalization invalid invocation invoke issuer iterator javascript join "
    "justification keyboard keystore knowledge language latest launch layer learn least legacy "
    "letter level lifecycle lifetime linear listener literature live locale lock login logout lookup "
    "machine mail maintenance management Manager market material mechanism media member merge "
    "middleware migration minimum mission mobile monitor multiple mutable mutation native navigation "
    "network normal notification observer occurrence official online operation operator opportunity "
    "optional organization origin original other overflow override owner parameters particular "
    "partition partner passphrase pattern payment performance period permission permissions "
    "Permissions persistence personal phone physical pipeline platform please policy pool popular "
    "position possible practice preference preferences Preferences previous principal priority "
    "problem procedure processor producer product profession program progress promise properties "
    "protected protection provision publish purchase purpose quality question quota range reaction "
    "reader ready real reason receive recommend recovery recursive reduce reference refresh Refresh "
    "refresh_token access_token register relation relationship reliable remember remove render "
    "renewal repeat replace report represent require required Required REQUIRED research reserved "
    "reset resolve responsible responsibilities restore restrict retry return reverse review revoke "
    "rotation router rule safety salt scale schedule science search second section secure Security "
    "selection sensitive separate sequence serializer services settings several share shared Shared "
    "should signal signing simple single Singleton situation social software solution something "
    "special specification standard statement station statistics step stream structure student "
    "subject submit subscribe subscription success summary supplied support Support SUPPORT switch symbol "
    "synchronize technology telephone temporary terminal through together tracking traffic training "
    "transfer transform translation transport traversal trigger trust tunnel "
    "understand understanding unique university unknown unlock until upgrade usage username Username "
    "validate validation Validation validator variety various vendor verification Verification "
    "verified verifier verify version virtual visible visitor wallet website whether wildcard without "
    "workflow workspace wrapper yesterday zone "
    "/usr/local/share/ /usr/local/lib/ /etc/ssl/certs/ /var/lib/ /opt/ /home/ application/json "
    "application/x-www-form-urlencoded text/plain multipart/form-data _in_seconds _for_ _from_ _with_ "
    "AuthenticationToken AccessToken RefreshToken UsernamePassword SecurityContext ProxyFactoryBean "
    "2020-01-01 2021- 2022- 2023- 2024- 2025-12-31 "
)


@dataclass(frozen=True)
class NoveltyRule:
    """When a string near a sensitive word counts as a secret.

    A candidate is a run of ``min_chars`` or more of the characters of keys, at
    most ``reach`` characters behind a sensitive word. ``around`` characters on both
    sides are the surrounding code. It is reported if it adds at least ``min_cost``
    compressed bytes per character to them, whatever kinds of characters it has. So a
    name of words that the dictionary does not know may be reported too.
    """

    min_chars: int = 16
    reach: int = 48
    around: int = 256
    min_cost: float = 0.6


_CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
_NEAR = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)


class NoveltyMeter:
    """Marginal compressed bytes of a string, given its surroundings and a dictionary."""

    def __init__(self, rule: NoveltyRule) -> None:
        primed = zstandard.ZstdCompressionDict(
            (PLAIN_WORDS + IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        self._rule = rule
        self._compress = zstandard.ZstdCompressor(
            level=19, dict_data=primed, write_checksum=False, write_content_size=False
        ).compress

    def cost(self, text: str, start: int, end: int) -> float:
        """Bytes per character that the string adds behind its surroundings."""
        around = self._rule.around
        known = (text[max(0, start - around) : start] + " " + text[end : end + around]).encode()
        value = text[start:end].encode()
        return (len(self._compress(known + b" " + value)) - len(self._compress(known))) / len(value)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; kinds by their place in ``KINDS``."""
    lowered = text.lower()
    spans = []
    if any(stem in lowered for stem in _ASSIGN_STEMS):
        spans += [
            (m.start(), 0, m.end())
            for m in ASSIGN.finditer(text)
            if len(m[2]) >= ASSIGN_VALUE_CHARS
        ]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


class _Taken:
    """Spans by kind; those of one kind do not overlap, so they are found by bisection."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self._by_kind: dict[int, tuple[list[int], list[int]]] = {}
        for start, kind, end in spans:
            starts, ends = self._by_kind.setdefault(kind, ([], []))
            starts.append(start)
            ends.append(end)

    def meeting(self, start: int, end: int) -> list[tuple[int, int]]:
        """The spans that share a character with a range, by start."""
        found = []
        for starts, ends in self._by_kind.values():
            met = slice(bisect_right(ends, start), bisect_left(starts, end))
            found += zip(starts[met], ends[met], strict=True)
        return sorted(found)


def _rest(start: int, end: int, met: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a range outside the sorted spans that meet it; none if there are none."""
    parts, done = [], start
    for s, e in met:
        parts.append((done, s))
        done = max(done, e)
    return [(a, b) for a, b in [*parts, (done, end)] if a < b] if parts else []


def candidates(text: str, rule: NoveltyRule) -> Iterator[tuple[int, int]]:
    """Runs of key characters that begin within reach of a sensitive word, left to right.

    A word may end inside a run; the rest of the run then counts. Words and runs are each
    found once and walked in step, so that the work is linear in the text.
    """
    runs = re.finditer(_CANDIDATE % rule.min_chars, text)
    run = next(runs, None)
    covered = 0
    for word in _NEAR.finditer(text):
        first = max(covered, word.end())
        while run and max(run.start(), first) - word.end() <= rule.reach:
            start = max(run.start(), first)
            if run.end() - start >= rule.min_chars:
                yield start, run.end()
                first = covered = run.end()
            run = next(runs, None)
        if not run:
            return


def novel_spans(
    text: str, taken: list[tuple[int, int, int]], meter: NoveltyMeter, rule: NoveltyRule
) -> list[tuple[int, int, int]]:
    """Strings behind a sensitive word that stay incompressible and are not whole in a taken span.

    One that a taken span covers in part is measured whole and also by the rest alone.
    """
    spans = []
    known = _Taken(taken)
    for start, end in candidates(text, rule):
        met = known.meeting(start, end)
        if any(s <= start and end <= e for s, e in met):
            continue
        parts = [(start, end), *_rest(start, end, met)]
        if any(meter.cost(text, *part) >= rule.min_cost for part in parts):
            spans.append((start, KINDS.index("novel"), end))
    return spans


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(text: str, meter: NoveltyMeter, rule: NoveltyRule) -> tuple[list, list]:
    """The base spans and all spans of a text, by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, meter, rule))


def secret_spans(docs: DataFrame, rule: NoveltyRule = NoveltyRule()) -> DataFrame:
    """Secrets in every text.

    Returns doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans.
    Places count code points, ends are exclusive, and texts are scanned whole. A
    null text counts as an empty one and has no span; repeated rows each give a row.
    """
    meter: list[NoveltyMeter] = []

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not meter:
            meter.append(NoveltyMeter(rule))
        rows = []
        for text in batch.column("text").to_pylist():
            base, spans = scan(text or "", meter[0], rule)
            kinds = [kind for _, kind, _ in spans]
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append((*(kinds.count(k) for k in range(len(KINDS))), digest, _joined(spans)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        names = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)

    schema = (
        "doc_id BIGINT, n_assign BIGINT, n_access BIGINT, n_hex BIGINT, n_novel BIGINT, "
        "base_sha256 STRING, spans STRING"
    )
    columns = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return in_pieces(columns, find, schema)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by a mark of its first kind."""
    parts, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            parts += [text[done:start], f"<{KINDS[kind]}-secret>"]
        elif end <= done:
            continue
        done = max(done, end)
    return "".join([*parts, text[done:]])


def redact_secrets(docs: DataFrame, rule: NoveltyRule = NoveltyRule()) -> DataFrame:
    """The same rows and columns, with secrets in ``text`` replaced by marks.

    ``n_chars``, if there, becomes the new length. A null text stays null.
    """
    meter: list[NoveltyMeter] = []

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not meter:
            meter.append(NoveltyMeter(rule))
        texts = [
            None if text is None else redacted(text, scan(text, meter[0], rule)[1])
            for text in batch.column("text").to_pylist()
        ]
        place = batch.schema.get_field_index("text")
        return batch.set_column(place, "text", pa.array(texts, pa.string()))

    cleaned = in_pieces(docs, clean, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(kind))
    return cleaned
