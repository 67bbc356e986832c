"""Column expressions over grids, activity, run statistics and the cost model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the area and energy model and of instruction costs follow where they are used.


def zero_based(c: Column) -> Column:
    return c - 1


def cell_xy(cc: Column, dim_y: int) -> tuple[Column, Column]:
    """Column and row of a cell."""
    return (cc % dim_y).cast("long"), F.floor(cc / dim_y).cast("long")


def cell_id(x: Column, y: Column, dim_y: int) -> Column:
    return (y * dim_y + x).cast("long")


def _axis(a: Column, b: Column, size: int, torus: bool) -> tuple[Column, Column]:
    """Signed way from a to b along an axis: direction (-1, 0, 1) and length."""
    d = b - a
    far = F.abs(d)
    if not torus:
        return F.signum(d), far
    wrapped = F.lit(size) - far
    return F.when(far <= wrapped, F.signum(d)).otherwise(-F.signum(d)), F.least(far, wrapped)


def hops(src: Column, dst: Column, dim_x: int, dim_y: int, network: str = "MESH") -> Column:
    """Network steps between two cells by the shortest way along each axis."""
    torus = network == "TORUS"
    (x1, y1), (x2, y2) = cell_xy(src, dim_y), cell_xy(dst, dim_y)
    return (_axis(x1, x2, dim_y, torus)[1] + _axis(y1, y2, dim_x, torus)[1]).cast("long")


def direction(src: Column, dst: Column, dim_x: int, dim_y: int, network: str = "MESH") -> Column:
    """First step of dimension-order routing, rows before columns: 0 left, 1 up, 2 right, 3
    down; null on arrival. A torus takes the shorter way, a tie goes direct."""
    torus = network == "TORUS"
    (x1, y1), (x2, y2) = cell_xy(src, dim_y), cell_xy(dst, dim_y)
    dx, dy = _axis(x1, x2, dim_y, torus)[0], _axis(y1, y2, dim_x, torus)[0]
    return F.when(dy < 0, 1).when(dy > 0, 3).when(dx < 0, 0).when(dx > 0, 2)


def in_box(a: Column, b: Column, dim_y: int, hx: int, hy: int) -> Column:
    """Whether two cells are within half of hx and hy of each other."""
    (x1, y1), (x2, y2) = cell_xy(a, dim_y), cell_xy(b, dim_y)
    return (F.abs(x1 - x2) <= hx // 2) & (F.abs(y1 - y2) <= hy // 2)


def use_mesh(src: Column, dst: Column, dim_x: int, dim_y: int) -> Column:
    """Whether a message stays on the mesh: the target is within a box around the source
    whose half sides are a share of the chip, 0.45 to 0.95, that grows with the
    source's distance from the centre."""
    (x1, y1), (x2, y2) = cell_xy(src, dim_y), cell_xy(dst, dim_y)
    ox, oy = x1 - (dim_y - 1) / 2.0, y1 - (dim_x - 1) / 2.0
    share = F.least(0.45 + 0.007 * F.sqrt(ox * ox + oy * oy), F.lit(0.95))
    return (F.abs(x1 - x2) <= F.floor(share * dim_y)) & (F.abs(y1 - y2) <= F.floor(share * dim_x))


def congestion(level: Column) -> Column:
    """Class of a channel's contention: thresholds 15, 30 and 60."""
    return F.when(level >= 60, 3).when(level >= 30, 2).when(level >= 15, 1).otherwise(0)


#: What a cell does in a cycle, by code.
ACTIVITY = [
    "idle", "communicating", "computing", "both",
    "communicating, congested 1", "communicating, congested 2", "communicating, congested 3", "communicating, congested 4",
    "both, congested 1", "both, congested 2", "both, congested 3", "both, congested 4",
]


def activity_code(compute: Column, communicate: Column, congested: Column, level: Column) -> Column:
    """Code 0 to 11; level (0 to 3) counts where a congested cell communicates."""
    return (
        F.when(compute & communicate & congested, 8 + level)
        .when(compute & communicate, 3)
        .when(compute, 2)
        .when(communicate & congested, 4 + level)
        .when(communicate, 1)
        .otherwise(0)
        .cast("int")
    )


def activity_class(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ACTIVITY)), code + 1)


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole; 0 if there is no whole."""
    return F.when(whole == 0, 0.0).otherwise(100.0 * part / whole)


def speedup(base: Column, value: Column) -> Column:
    return base / value


def decrease_percent(base: Column, value: Column) -> Column:
    return 100.0 * (base - value) / base


def increase_percent_of_variant(base: Column, variant: Column) -> Column:
    """Increase from base to variant, as a share of the variant."""
    return 100.0 * (variant - base) / variant


def throttle_period(dx: Column, dy: Column, network: Column) -> Column:
    """Whole part of the diagonal, halved on a torus."""
    return F.floor(F.sqrt(dx * dx + dy * dy) / F.when(network == "TORUS", 2).otherwise(1)).cast("long")


def chip_dim(dim: Column, depth: Column) -> Column:
    return (dim * F.pow(F.lit(2), depth)).cast("long")


def on_off(flag: Column) -> Column:
    return F.when(flag, "ON").otherwise("OFF")


def network_name(kind: Column) -> Column:
    return F.when(kind == 0, "MESH").when(kind == 1, "TORUS")


def queue_full(size: Column, capacity: int, at: float) -> Column:
    return 100.0 * size / capacity > at


#: Cycles that an instruction takes.
INSTRUCTION = {"add": 1, "sub": 1, "mul": 5, "div": 30, "load": 1, "store": 1}


def name_part(name: Column, k: int, separator: str = "_") -> Column:
    """The k-th field of a file name, from 0; null beyond the last."""
    return F.try_element_at(F.split(name, separator), F.lit(k + 1))


def two_places(x: Column) -> Column:
    return F.format_string("%.2f", x.cast("double"))


def slice_of(list_: Column, start: int, n: int) -> Column:
    return F.slice(list_, start + 1, n)


# Fixed values of the area and energy model (SI units).
CLOCK_HZ = 1e9
FLIT_BITS = 256
WORD_BITS = 64
PAYLOAD_BYTES = 4
ACTION_BYTES = 4
SRAM_BYTES_PER_M2 = 29.2e6 / 8 / 1e-6
SRAM_LEAKAGE_W_PER_BYTE = 16.9e-6 / 32768
SRAM_READ_J = 5.8e-12
SRAM_WRITE_J = 9.12e-12
MESSAGE_J_PER_BIT_M = 8e-12 / 32 / 1e-3
TRANSISTORS_PER_M2 = 91e12
EXECUTION_UNIT_TRANSISTORS = 100e3
FLIP_FLOP_TRANSISTORS = 12
MUX2_TRANSISTORS = 8
TORUS_FACTOR = 1.5
RUCHE_LENGTH = 3


def _mux(n: int) -> int:
    """Transistors of an n:1 multiplexer, a tree of 2:1 ones."""
    return (n - 1) * MUX2_TRANSISTORS


def router_transistors(network: str) -> float:
    """Of one cell's router: ports' buffers and multiplexers."""
    buffers = (5 * 2 + 4) * FLIP_FLOP_TRANSISTORS
    mesh = FLIT_BITS * (buffers + 2 * _mux(2) + 2 * _mux(4) + _mux(5))
    ruche = FLIT_BITS * (buffers + 4 * FLIP_FLOP_TRANSISTORS + 2 * _mux(3) + 2 * _mux(6) + _mux(7) + 2 * _mux(2))
    return {"MESH": mesh, "TORUS": mesh * TORUS_FACTOR, "RUCHE": ruche, "RUCHE_TORUS": ruche - mesh + mesh * TORUS_FACTOR}[network]


def cell_area(memory: Column, network: str) -> Column:
    """Square metres of a cell."""
    return memory / SRAM_BYTES_PER_M2 + router_transistors(network) / TRANSISTORS_PER_M2 + EXECUTION_UNIT_TRANSISTORS / TRANSISTORS_PER_M2


def cost_model(
    network: str, cycles: Column, operons: Column, created: Column, performed: Column, dim: Column, memory: Column, ruche_operons: Column | None = None
) -> tuple[Column, Column, Column]:
    """Chip area in mm^2, energy in J and time in s of a run on a dim x dim chip whose cells
    hold memory bytes. On Ruche variants ruche_operons of the operons go over Ruche links, of RUCHE_LENGTH
    cells on either network, and the others as without them; more than there are operons is an error."""
    area = cell_area(memory, network)
    side = F.sqrt(area)
    step = 2 * (dim - 1) * side / dim if network.endswith("TORUS") else side
    per_metre = FLIT_BITS * MESSAGE_J_PER_BIT_M
    moving = operons * step * per_metre
    if network.startswith("RUCHE"):
        over = F.lit(0.0) if ruche_operons is None else ruche_operons
        far = (operons - over) * step * per_metre + over * side * RUCHE_LENGTH * per_metre
        moving = F.when(over > operons, F.raise_error(F.lit("more operons over Ruche links than in all"))).otherwise(far)
    words = WORD_BITS / 8
    access = created * PAYLOAD_BYTES / words * SRAM_READ_J + performed * ACTION_BYTES / words * SRAM_WRITE_J
    time = cycles / CLOCK_HZ
    leakage = dim * dim * memory * SRAM_LEAKAGE_W_PER_BYTE * time
    return dim * dim * area * 1e6, moving + access + leakage, time
