"""Readers of further text formats: ABAQUS, I-deas universal, RTT, SMS and MCNP mesh tallies; writers of GMV and ANSYS."""

from __future__ import annotations

import re

from ..model import CORNERS, EDGE, HEX, POLYGON, PRISM, PYRAMID, QUAD, TET, TRI, MeshError
from . import files
from .files import Parsed

# Element names of ABAQUS by their beginnings, longest first, and of I-deas by number.
ABAQUS_TYPES = {"C3D4": TET, "C3D10": TET, "C3D6": PRISM, "C3D15": PRISM, "C3D8": HEX, "C3D20": HEX, "DC3D8": HEX, "DC3D4": TET, "CPE3": TRI, "CPS3": TRI, "CPE4": QUAD, "CPS4": QUAD, "S3": TRI, "S4": QUAD, "DS3": TRI, "DS4": QUAD, "B31": EDGE, "B32": EDGE, "T3D2": EDGE, "B23": EDGE}
IDEAS_TYPES = {11: EDGE, 21: EDGE, 22: EDGE, 41: TRI, 61: TRI, 74: TRI, 91: TRI, 44: QUAD, 64: QUAD, 71: QUAD, 94: QUAD, 111: TET, 112: PRISM, 115: HEX, 116: HEX, 118: TET}
# Universal datasets of nodes and elements.
IDEAS_NODES, IDEAS_ELEMENTS = ("2411", "781"), ("2412", "780")


def parse_abaqus(data: bytes) -> Parsed:
    """ABAQUS input: nodes, elements, node and element sets (named, or given by a keyword of their own, also by steps).

    Sets of nodes come as sets, too; instances and assemblies are read flat.
    """
    out, nodes, cells = Parsed(), {}, {}
    keyword, options, held = "", {}, ""
    node_sets: dict[str, list[int]] = {}
    cell_sets: dict[str, list[int]] = {}

    def take(row: list[str]) -> None:
        if keyword == "NODE":
            nodes[int(row[0])] = len(out.points)
            out.points.append(tuple(map(float, (row[1:4] + ["0", "0"])[:3])))
            if "NSET" in options:
                node_sets.setdefault(options["NSET"], []).append(int(row[0]))
        elif keyword == "ELEMENT":
            name = options.get("TYPE", "").upper()
            known = [k for k in ABAQUS_TYPES if re.fullmatch(rf"{k}[A-Z]*", name)]
            if not known:
                raise MeshError("NOT_IMPLEMENTED", f"ABAQUS element {name}")
            cells[int(row[0])] = len(out.cells)
            out.cells.append((ABAQUS_TYPES[max(known, key=len)], [nodes[int(x)] for x in row[1:]]))
            if "ELSET" in options:
                cell_sets.setdefault(options["ELSET"], []).append(int(row[0]))
        elif keyword in ("NSET", "ELSET"):
            into = (node_sets if keyword == "NSET" else cell_sets).setdefault(options.get(keyword, "unnamed"), [])
            if "GENERATE" in options:
                a, b, step = (list(map(int, row)) + [1])[:3]
                into += range(a, b + 1, step)
            else:
                for x in row:
                    into += [int(x)] if x.lstrip("-").isdigit() else (node_sets if keyword == "NSET" else cell_sets).get(x, [])

    need = 0
    for line in data.decode("utf-8", "replace").splitlines():
        line = line.strip()
        if not line or line.startswith("**"):
            continue
        if line.startswith("*"):
            if held:
                take([x.strip() for x in held.split(",") if x.strip()])
            held = ""
            first, *rest = [x.strip() for x in line[1:].split(",")]
            keyword = first.upper()
            options = {k.strip().upper(): v.strip() for k, _, v in (x.partition("=") for x in rest if x)}
            need = 0
            if keyword == "ELEMENT":
                size = [CORNERS[ABAQUS_TYPES[k]] for k in ABAQUS_TYPES if re.fullmatch(rf"{k}[A-Z]*", options.get("TYPE", "").upper())]
                digits = re.search(r"D(\d+)", options.get("TYPE", "").upper().replace("C3D", "D"))
                need = 1 + max([*size, int(digits[1]) if digits else 0], default=0)
        elif keyword in ("NODE", "ELEMENT", "NSET", "ELSET"):
            held += line if not held or held.endswith(",") else "," + line
            row = [x.strip() for x in held.split(",") if x.strip()]
            if keyword != "ELEMENT" or len(row) >= need:
                take(row)
                held = ""
    if held:
        take([x.strip() for x in held.split(",") if x.strip()])
    out.sets = {name: [cells[i] for i in ids if i in cells] for name, ids in cell_sets.items()}
    out.point_sets = {name: [nodes[i] for i in ids if i in nodes] for name, ids in node_sets.items()}
    return out


def parse_ideas(data: bytes) -> Parsed:
    """I-deas universal files: nodes (2411, 781) and elements (2412, 780); materials as sets."""
    lines = data.decode("utf-8", "replace").splitlines()
    out, ids, at = Parsed(), {}, 0
    while at < len(lines):
        if lines[at].strip() != "-1" or at + 1 >= len(lines):
            at += 1
            continue
        kind, at = lines[at + 1].strip(), at + 2
        end = next((i for i in range(at, len(lines)) if lines[i].strip() == "-1"), len(lines))
        body = lines[at:end]
        if kind in IDEAS_NODES:
            for head, place in zip(body[::2], body[1::2]):
                ids[int(head.split()[0])] = len(out.points)
                out.points.append(tuple(float(x.replace("D", "E").replace("d", "e")) for x in place.split()[:3]))
        elif kind in IDEAS_ELEMENTS:
            i = 0
            while i < len(body):
                number, form, _, material, _, n = map(int, body[i].split()[:6])
                if form not in IDEAS_TYPES:
                    raise MeshError("NOT_IMPLEMENTED", f"I-deas element {form}")
                i += 2 if IDEAS_TYPES[form] == EDGE else 1  # beams have a line of their own
                conn: list[int] = []
                while len(conn) < n:
                    conn += [ids[int(x)] for x in body[i].split()]
                    i += 1
                out.sets.setdefault(f"material:{material}", []).append(len(out.cells))
                out.cells.append((IDEAS_TYPES[form], conn))
        at = end + 1
    return out


def parse_rtt(data: bytes) -> Parsed:
    """RTT meshes of versions 1.0.0 and 1.0.1: nodes, triangles on sides, tetrahedra; sides and materials as sets."""
    lines = [x.strip() for x in data.decode("utf-8", "replace").splitlines()]
    if not lines or not lines[0].startswith("rtt_ascii"):
        raise MeshError("FAILURE", "not an RTT file")
    version = next((x.split()[1] for x in lines if x.startswith("version")), "v1.0.0")
    typed = 0 if version == "v1.0.0" else 1  # a column for the kind of cell

    def part(name: str) -> list[list[str]]:
        if name not in lines or f"end_{name}" not in lines:
            return []
        return [x.split() for x in lines[lines.index(name) + 1 : lines.index(f"end_{name}")] if x]

    out, ids = Parsed(), {}
    for row in part("nodes"):
        ids[int(row[0])] = len(out.points)
        out.points.append(tuple(map(float, row[1:4])))
    for rows, etype, label in ((part("sides"), TRI, "side"), (part("cells"), TET, "material")):
        for row in rows:
            n = CORNERS[etype]
            rest = row[1 + typed :]
            out.sets.setdefault(f"{label}:{rest[n]}", []).append(len(out.cells))
            out.cells.append((etype, [ids[int(x)] for x in rest[:n]]))
    return out


def parse_sms(data: bytes) -> Parsed:
    """SMS meshes: vertices, edges by vertices, faces by edges, regions by faces; geometric entities as sets."""
    words = iter(data.split())
    take = lambda kind=int: kind(next(words))
    if next(words, b"") != b"sms":
        raise MeshError("FAILURE", "not an SMS file")
    if take() == 3:
        raise MeshError("NOT_IMPLEMENTED", "SMS with part data")
    n_regions, n_faces, n_edges, n_vertices, _ = (take() for _ in range(5))
    out = Parsed()

    def parameters(dim: int) -> None:
        for _ in range({1: 1, 2: 3}.get(dim, 0)):
            take(float)

    def owned(dim: int, ident: int) -> None:
        out.sets.setdefault(f"geometry:{dim}:{ident}", []).append(len(out.cells))

    for _ in range(n_vertices):
        if not take():
            out.points.append((0.0, 0.0, 0.0))
            continue
        dim, _links = take(), take()
        out.points.append((take(float), take(float), take(float)))
        parameters(dim)
    edges: list[tuple[int, int]] = []
    for _ in range(n_edges):
        ident = take()
        if not ident:
            edges.append((0, 0))
            continue
        dim, a, b, _links, n = (take() for _ in range(5))
        for _ in range(n):
            parameters(dim)
        edges.append((a - 1, b - 1))
        owned(dim, ident)
        out.cells.append((EDGE, [a - 1, b - 1]))
    faces: list[list[int]] = []
    for _ in range(n_faces):
        ident = take()
        if not ident:
            faces.append([])
            continue
        dim, n = take(), take()
        ring = [edges[abs(take()) - 1] for _ in range(n)]
        conn = [next(iter(set(p) & set(q))) for p, q in zip(ring, ring[1:] + ring[:1])]
        for _ in range(take()):
            parameters(dim)
        faces.append(conn)
        owned(dim, ident)
        out.cells.append(({3: TRI, 4: QUAD}.get(n, POLYGON), conn))
    for _ in range(n_regions):
        ident = take()
        if not ident:
            continue
        bound = [(int(x > 0), faces[abs(x) - 1]) for x in (take() for _ in range(take()))]
        take()
        owned(3, ident)
        out.cells.append(_region([f if forward else f[::-1] for forward, f in bound]))
    return out


def _region(faces: list[list[int]]) -> tuple[int, list[int]]:
    """Type and vertices of a solid whose faces run outward: its first face (a quad, if it has one) seen from inside, then what stands above it."""
    shape = tuple(sorted(map(len, faces)))
    known = {(3, 3, 3, 3): TET, (3, 3, 3, 3, 4): PYRAMID, (3, 3, 4, 4, 4): PRISM, (4,) * 6: HEX}
    if shape not in known:
        raise MeshError("NOT_IMPLEMENTED", f"region of faces {shape}")
    etype = known[shape]
    base = next(f for f in faces if len(f) == (4 if etype in (PYRAMID, HEX) else 3))[::-1]
    if etype in (TET, PYRAMID):
        return etype, base + list({v for f in faces for v in f} - set(base))
    pairs = {frozenset(p) for f in faces for p in zip(f, f[1:] + f[:1])}
    above = [next(w for p in pairs if v in p for w in p if w not in base) for v in base]
    return etype, base + above


def parse_meshtal(data: bytes) -> Parsed:
    """Rectangular MCNP mesh tallies: hexahedra between the bin boundaries, results and relative errors as values on them.

    Several tallies of a file share one grid; results summed over energies stand
    under the tally's name, of single energies they are left out where a total is given.
    """
    text = data.decode("utf-8", "replace").splitlines()
    out = Parsed()
    axes: dict[str, list[float]] = {}
    tally, columns, built = "", [], False
    for line in text:
        w = line.split()
        if line.strip().startswith("Mesh Tally Number"):
            tally = w[-1]
        elif m := re.match(r"\s*([XYZ]) direction:\s*(.*)", line):
            axes[m[1]] = list(map(float, m[2].split()))
        elif "Cylinder origin" in line:
            raise MeshError("NOT_IMPLEMENTED", "cylindrical tally")
        elif w[:3] == ["X", "Y", "Z"] or w[:4] == ["Energy", "X", "Y", "Z"]:
            columns = ["Energy"] * (w[0] == "Energy") + ["X", "Y", "Z", "Result", "Error"]
            if not built:
                _tally_grid(out, axes)
                built = True
        elif columns and len(w) == len(columns):
            row = dict(zip(columns, w))
            if row.get("Energy", "Total") != "Total":
                continue
            i, j, k = (sum(float(row[c]) > x for x in axes[c][1:-1]) for c in "XYZ")
            at = i + (len(axes["X"]) - 1) * (j + (len(axes["Y"]) - 1) * k)
            out.values += [(f"TALLY_{tally}", False, at, float(row["Result"])), (f"ERROR_{tally}", False, at, float(row["Error"]))]
        elif columns and w:
            columns = []
    return out


def _tally_grid(out: Parsed, axes: dict[str, list[float]]) -> None:
    nx, ny, nz = (len(axes[c]) for c in "XYZ")
    out.points = [(x, y, z) for z in axes["Z"] for y in axes["Y"] for x in axes["X"]]
    ring = ((0, 0), (1, 0), (1, 1), (0, 1))
    for k in range(nz - 1):
        for j in range(ny - 1):
            for i in range(nx - 1):
                out.cells.append((HEX, [i + a + nx * (j + b + ny * (k + c)) for c in (0, 1) for a, b in ring]))


for _suffix, _parser in (("abq", parse_abaqus), ("inp", parse_abaqus), ("unv", parse_ideas), ("rtt", parse_rtt), ("sms", parse_sms), ("meshtal", parse_meshtal)):
    files.register_reader(_suffix, _parser)
