"""Readers and writers of transducer files, archives and their metadata.

Files are decoded on the driver: they are dictionary resources whose size does not
depend on the data.  They may lie on this machine, or wherever Spark can read
(:func:`open_stored`).  A slot of the index table, or a state inside the transition table,
leads to a run of consecutive records with one input symbol; those are the arcs that
exist, whatever else lies in the file.
"""

from __future__ import annotations

import json
import struct
import xml.etree.ElementTree as ElementTree
import zipfile
from dataclasses import dataclass, field
from io import BytesIO
from pathlib import Path

import numpy as np

from ..model import IDENTITY, UNKNOWN, Fst

TARGET_TABLE = 1 << 31
NO_SYMBOL, NO_TARGET = 0xFFFF, 0xFFFFFFFF
EPSILON = "@_EPSILON_SYMBOL_@"
_INDEX_6 = np.dtype([("sym", "<u2"), ("target", "<u4")])
_INDEX_8 = np.dtype([("sym", "<u2"), ("pad", "<u2"), ("target", "<u4")])
_TRANSITION = np.dtype([("in", "<u2"), ("out", "<u2"), ("target", "<u4"), ("weight", "<f4")])
#: Flag operations by their long names in alphabet files.
_OPERATIONS = {"PositiveSet": "P", "NegativeSet": "N", "Require": "R", "Disallow": "D", "Clear": "C", "Unification": "U"}
#: The nine properties of a file header, in order.
PROPERTIES = ("weighted", "deterministic", "input_deterministic", "minimized", "cyclic", "has_epsilon_epsilon_transitions", "has_input_epsilon_transitions", "has_input_epsilon_cycles", "has_unweighted_input_epsilon_cycles")


class UnsupportedArchive(ValueError):
    """A path that no reader is for."""


class CorruptArchive(ValueError):
    """A file that ends early or contradicts itself."""


def _arcs(index: np.ndarray, transitions: np.ndarray, n_symbols: int, flags: set[int]) -> tuple[list, dict[int, float]]:
    """Arcs and final weights of the states reachable from the start, numbered from 0."""
    number: dict[int, int] = {0: 0}
    todo, arcs, finals = [0], [], {}
    reads, writes, targets, weights = (transitions[n].tolist() for n in ("in", "out", "target", "weight"))
    # slots of the index that lead somewhere, with their symbols
    slots = np.flatnonzero((index["sym"] != NO_SYMBOL) & (index["target"] != NO_TARGET))
    slot_symbols, slot_targets = index["sym"][slots].astype(np.int64), index["target"][slots].tolist()
    #: the state that a slot belongs to, if its symbol is right for its place
    bounds = slots - 1 - slot_symbols
    by_state = np.argsort(bounds, kind="stable")
    owners = bounds[by_state]

    def run(at: int, want: set[int] | None) -> list[int]:
        """Records from ``at`` on: those of one input symbol, or all epsilons and flags."""
        out = []
        symbol = None
        while at < len(reads):
            s = reads[at]
            if s == NO_SYMBOL or (want is not None and s not in want) or (want is None and symbol is not None and s != symbol):
                break
            symbol = s
            out.append(at)
            at += 1
        return out

    while todo:
        state = todo.pop()
        here = number[state]
        records: list[int] = []
        if state >= TARGET_TABLE:
            at = state - TARGET_TABLE
            if at >= len(reads):
                raise CorruptArchive(f"transition {at} of {len(reads)}")
            if reads[at] == NO_SYMBOL and targets[at] == 1:
                finals[here] = weights[at]
            if at + 1 < len(reads):
                first = reads[at + 1]
                records = run(at + 1, {0, *flags} if first == 0 or first in flags else {first})
        else:
            if state >= len(index):
                raise CorruptArchive(f"state {state} of {len(index)}")
            if int(index["sym"][state]) == NO_SYMBOL and int(index["target"][state]) != NO_TARGET:
                finals[here] = struct.unpack("<f", struct.pack("<I", int(index["target"][state])))[0]
            lo, hi = np.searchsorted(owners, [state, state + 1])
            for slot in by_state[lo:hi].tolist():
                symbol = int(slot_symbols[slot])
                if symbol < n_symbols:
                    records += run(slot_targets[slot] - TARGET_TABLE, {0, *flags} if symbol == 0 else {symbol})
        for r in dict.fromkeys(records):
            target = targets[r]
            if target == NO_TARGET:
                continue
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            arcs.append((here, reads[r], writes[r], number[target], weights[r]))
    return arcs, finals


Files = dict[str, bytes]


def _files(folder: str | Path) -> Files:
    """The files of a local folder by their path in it."""
    folder = Path(folder)
    return {f.relative_to(folder).as_posix(): f.read_bytes() for f in sorted(folder.rglob("*")) if f.is_file()}


def _within(files: Files, folder: str) -> Files:
    return {name[len(folder) + 1 :]: data for name, data in files.items() if name.startswith(folder + "/")}


def _decoded(files: Files) -> Fst:
    """A transducer from the files of its folder, whole or in numbered parts."""

    def joined(name: str) -> bytes:
        if name in files:
            return files[name]
        parts = sorted((f for f in files if f.startswith(name + ".")), key=lambda f: int(f.rsplit(".", 1)[1]))
        if not parts:
            raise CorruptArchive(f"no {name} table")
        return b"".join(files[f] for f in parts)

    if "alphabet" not in files:
        raise CorruptArchive("no alphabet")
    return _thfst(json.loads(files["alphabet"].decode("utf-8")), joined("index"), joined("transition"))


def read_thfst(folder: str | Path) -> Fst:
    """A folder with ``alphabet`` (JSON), ``index`` (8-byte rows) and ``transition``."""
    return _decoded(_files(folder))


def _table(data: bytes, dtype: np.dtype, what: str) -> np.ndarray:
    if len(data) % dtype.itemsize:
        raise CorruptArchive(f"the {what} table is cut off")
    return np.frombuffer(data, dtype)


def _thfst(alphabet: dict, index: bytes, transition: bytes) -> Fst:
    keys = list(alphabet["key_table"])
    flags = {}
    for key, op in alphabet.get("operations", {}).items():
        flags[int(key)] = (_OPERATIONS.get(op["operation"], op["operation"]), int(op["feature"]), int(op["value"]))
    for name, special in ((IDENTITY, alphabet.get("identity_symbol")), (UNKNOWN, alphabet.get("unknown_symbol"))):
        if special is not None:
            keys[special] = name
    arcs, finals = _arcs(_table(index, _INDEX_8, "index"), _table(transition, _TRANSITION, "transition"), len(keys), set(flags))
    return Fst(keys, arcs, finals, flags)


def read_thfst_chunks(folder: str | Path) -> Fst:
    """As :func:`read_thfst`, with tables in numbered parts (``index.0`` ...)."""
    return _decoded(_files(folder))


@dataclass
class Header:
    """The fixed part at the head of an optimised-lookup file."""

    symbols: int
    input_symbols: int
    index_size: int
    target_size: int
    states: int
    transitions: int
    properties: dict[str, bool]
    size: int


def read_header(data: bytes) -> Header:
    try:
        at = 8 + struct.unpack_from("<H", data, 5)[0]
        inputs, symbols, index, targets, states, transitions = struct.unpack_from("<HHIIII", data, at)
        flags = struct.unpack_from("<9I", data, at + 20)
    except struct.error as e:
        raise CorruptArchive("the header is cut off") from e
    return Header(symbols, inputs, index, targets, states, transitions, dict(zip(PROPERTIES, map(bool, flags))), at + 56)


def read_hfst(data: bytes) -> Fst:
    """An optimised-lookup transducer: header, NUL-ended symbols, 6-byte index rows, transitions."""
    header = read_header(data)
    at, keys, flags = header.size, [], {}
    features: dict[str, int] = {}
    values: dict[str, int] = {"@N@": 0}
    for i in range(header.symbols):
        end = data.find(b"\0", at)
        if end < 0:
            raise CorruptArchive("the alphabet is cut off")
        key = data[at:end].decode("utf-8", "replace")
        at = end + 1
        if key == EPSILON:
            key = ""
        elif len(key) >= 5 and key[0] == "@" == key[-1] and key[2] == "." and key[1] in "PNRDCU":
            feature, _, value = key[3:-1].partition(".")
            f = features.setdefault(feature, len(features))
            v = values.setdefault(value, len(values)) if value else 0
            flags[i] = (key[1], f, v)
        elif key not in (IDENTITY, UNKNOWN) and key.startswith("@") and key.endswith("@") and len(key) > 1:
            key = ""
        keys.append(key)
    index_end = at + header.index_size * 6
    end = index_end + header.target_size * 12
    if len(data) < end:
        raise CorruptArchive("the tables are cut off")
    arcs, finals = _arcs(np.frombuffer(data[at:index_end], _INDEX_6), np.frombuffer(data[index_end:end], _TRANSITION), header.symbols, set(flags))
    return Fst(keys, arcs, finals, flags)


def tables(fst: Fst) -> tuple[np.ndarray, np.ndarray]:
    """(index with 8-byte rows, transitions) of a transducer; every state is in the index."""
    states = sorted(fst.states())
    width = len(fst.keys) + 1
    place = {s: i * width for i, s in enumerate(states)}
    index = np.zeros(len(states) * width, _INDEX_8)
    index["sym"], index["target"] = NO_SYMBOL, NO_TARGET
    rows: list[tuple[int, int, int, float]] = []
    edge = (NO_SYMBOL, NO_SYMBOL, NO_TARGET, 0.0)
    for s in states:
        by = fst.arcs.get(s, {})
        if s in fst.finals:
            index["target"][place[s]] = struct.unpack("<I", struct.pack("<f", fst.finals[s]))[0]
        free = [k for k in by if k == 0 or k in fst.flags]
        if free:
            index[place[s] + 1] = (0, 0, TARGET_TABLE + len(rows))
            rows += [(k, o, place[d], w) for k in sorted(free) for o, d, w in by[k]]
            rows.append(edge)
        for k in sorted(set(by) - set(free)):
            index[place[s] + 1 + k] = (k, 0, TARGET_TABLE + len(rows))
            rows += [(k, o, place[d], w) for o, d, w in by[k]]
            rows.append(edge)
    return index, np.array(rows or [edge], _TRANSITION)


def write_thfst(fst: Fst, folder: str | Path, chunks: int = 0) -> Path:
    """Writes a folder for :func:`read_thfst`, or with numbered parts for the chunked reader."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    index, transitions = tables(fst)
    long = {v: k for k, v in _OPERATIONS.items()}
    alphabet = {
        "key_table": fst.keys, "initial_symbol_count": fst.initial_count, "flag_state_size": fst.n_features, "length": len(fst.keys),
        "string_to_symbol": dict(fst.by_key), "operations": {str(k): {"operation": long[o], "feature": f, "value": v} for k, (o, f, v) in fst.flags.items()},
        "identity_symbol": fst.identity, "unknown_symbol": fst.unknown,
    }
    (folder / "alphabet").write_text(json.dumps(alphabet, ensure_ascii=False, indent=2), "utf-8")
    for name, table in (("index", index), ("transition", transitions)):
        data = table.tobytes()
        if not chunks:
            (folder / name).write_bytes(data)
            continue
        per = -(-len(table) // chunks) * table.itemsize
        for i in range(chunks):
            (folder / f"{name}.{i}").write_bytes(data[i * per : (i + 1) * per])
    return folder


def write_hfst(fst: Fst) -> bytes:
    """The bytes of an optimised-lookup file for :func:`read_hfst`; flag keys must be spelled out."""
    index, transitions = tables(fst)
    small = np.zeros(len(index), _INDEX_6)
    small["sym"], small["target"] = index["sym"], index["target"]
    keys = [k if i else EPSILON for i, k in enumerate(fst.keys)]
    head = b"HFST\0" + struct.pack("<H", 0) + b"\0"
    head += struct.pack("<HHIIII", len(keys), len(keys), len(index), len(transitions), len(fst.states()), len(fst.arc_rows())) + struct.pack("<9I", 1, *[0] * 8)
    return head + b"".join(k.encode() + b"\0" for k in keys) + small.tobytes() + transitions.tobytes()


@dataclass
class Titled:
    """An acceptor or error model as an archive's metadata describes it."""

    id: str = ""
    type: str | None = None
    titles: list[tuple[str | None, str]] = field(default_factory=list)
    description: str | None = None
    continuation: str | None = None


@dataclass
class Metadata:
    """What an archive says of itself."""

    locale: str = ""
    titles: list[tuple[str | None, str]] = field(default_factory=list)
    description: str | None = None
    producer: str | None = None
    acceptor: Titled = field(default_factory=Titled)
    errmodel: Titled = field(default_factory=Titled)

    def to_dict(self) -> dict:
        titles = lambda ts: [{"lang": lang, "value": v} for lang, v in ts]
        part = lambda p: {"id": p.id, "type": p.type, "title": titles(p.titles), "description": p.description, "continuation": p.continuation}
        return {"info": {"locale": self.locale, "title": titles(self.titles), "description": self.description, "producer": self.producer}, "acceptor": part(self.acceptor), "errmodel": part(self.errmodel)}

    @classmethod
    def from_dict(cls, d: dict) -> Metadata:
        titles = lambda ts: [(t.get("lang"), t.get("value", "")) for t in ts or []]
        part = lambda p: Titled(p.get("id", ""), p.get("type"), titles(p.get("title")), p.get("description"), p.get("continuation"))
        info = d.get("info", {})
        return cls(info.get("locale", ""), titles(info.get("title")), info.get("description"), info.get("producer"), part(d.get("acceptor", {})), part(d.get("errmodel", {})))


def parse_metadata(data: bytes | str) -> Metadata:
    """Metadata from XML (``index.xml``) or JSON (``meta.json``)."""
    text = data.decode("utf-8-sig") if isinstance(data, bytes) else data
    if text.lstrip().startswith("{"):
        return Metadata.from_dict(json.loads(text))
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise CorruptArchive(f"the metadata is no XML: {e}") from e

    def titles(node: ElementTree.Element | None) -> list[tuple[str | None, str]]:
        return [] if node is None else [(t.get("{http://www.w3.org/XML/1998/namespace}lang") or t.get("lang"), (t.text or "").strip()) for t in node.findall("title")]

    def part(node: ElementTree.Element | None) -> Titled:
        return Titled() if node is None else Titled(node.get("id", ""), node.get("type"), titles(node), node.findtext("description"), node.findtext("continuation"))

    info = root.find("info")
    return Metadata(root.findtext("info/locale", ""), titles(info), root.findtext("info/description"), root.findtext("info/producer"), part(root.find("acceptor")), part(root.find("errmodel")))


@dataclass
class Archive:
    """A lexicon, an error model and what the archive says of them."""

    lexicon: Fst
    mutator: Fst
    metadata: Metadata | None

    def speller(self):
        from ..operators.suggest import Speller

        return Speller(self.lexicon, self.mutator)

    @property
    def locale(self) -> str | None:
        return self.metadata.locale if self.metadata else None


def open_archive(path: str | Path) -> Archive:
    """Opens by suffix: ``.zhfst`` (a zip with ``index.xml``) or ``.bhfst`` (a folder with the
    default acceptor and error model; the packed box format has no public description)."""
    path = Path(path)
    if path.suffix == ".zhfst":
        return _open_zip(path.read_bytes())
    if path.suffix == ".bhfst":
        if not path.is_dir():
            raise UnsupportedArchive(f"{path.name}: only unpacked .bhfst folders are supported")
        return _unpacked(_files(path))
    raise UnsupportedArchive(f"unsupported archive: {path.name}")


def _unpacked(files: Files) -> Archive:
    acceptor, errmodel = (_decoded(_within(files, f"{part}.default.thfst")) for part in ("acceptor", "errmodel"))
    return Archive(acceptor, errmodel, parse_metadata(files["meta.json"]) if "meta.json" in files else None)


def open_stored(spark, path: str) -> Archive:
    """As :func:`open_archive`, from any file system that Spark reads: the files come as
    binary rows."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name.endswith(".zhfst"):
        row = spark.read.format("binaryFile").load(path).select("content").first()
        return _open_zip(bytes(row[0]))
    if name.endswith(".bhfst"):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").collect()
        return _unpacked({r["path"].rsplit(f"{name}/", 1)[1]: bytes(r["content"]) for r in rows})
    raise UnsupportedArchive(f"unsupported archive: {name}")


def _open_zip(data: bytes) -> Archive:
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            meta = parse_metadata(z.read("index.xml"))
            return Archive(read_hfst(z.read(meta.acceptor.id)), read_hfst(z.read(meta.errmodel.id)), meta)
    except (zipfile.BadZipFile, KeyError) as e:
        raise CorruptArchive(f"the archive cannot be read: {e}") from e


def write_archive(archive: Archive, target: str | Path) -> Path:
    """Writes a lexicon and an error model as an unpacked ``.bhfst`` folder; ids in the
    metadata are renamed to match."""
    target = Path(target)
    write_thfst(archive.lexicon, target / "acceptor.default.thfst")
    write_thfst(archive.mutator, target / "errmodel.default.thfst")
    if archive.metadata is not None:
        described = archive.metadata.to_dict()
        for part in ("acceptor", "errmodel"):
            described[part]["id"] = described[part]["id"].replace(".hfst", ".thfst")
        (target / "meta.json").write_text(json.dumps(described, ensure_ascii=False, indent=2), "utf-8")
    return target


def convert_archive(source: str | Path, target: str | Path) -> Path:
    """Turns a ``.zhfst`` into an unpacked ``.bhfst`` folder."""
    archive = open_archive(source)
    return write_archive(Archive(archive.lexicon, archive.mutator, archive.metadata or Metadata()), target)


def archive_info(archive: Archive) -> dict:
    """What an archive holds: its metadata, and the size of both transducers."""
    size = lambda f: {"symbols": len(f.keys), "flags": len(f.flags), "states": len(f.states()), "arcs": len(f.arc_rows()), "finals": len(f.finals)}
    return {"metadata": archive.metadata.to_dict() if archive.metadata else None, "acceptor": size(archive.lexicon), "errmodel": size(archive.mutator)}


def find_speller(tag: str, folders: list[str | Path]) -> Path | None:
    """The first installed archive of a language tag, unpacked before zipped."""
    for folder in map(Path, folders):
        for suffix in (".bhfst", ".zhfst"):
            if (hit := folder / f"{tag}{suffix}").exists():
                return hit
    return None
