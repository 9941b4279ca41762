"""The features of the linear models, one character at a time."""

from lectern.llm import common, subwords

BITS64 = (1 << 64) - 1


def mix(x: int) -> int:
    x = (x ^ (x >> 32)) * int(common.MIX) & BITS64
    x = (x ^ (x >> 29)) * int(common.BASE) & BITS64
    return x ^ (x >> 32)


def is_space(c: str) -> bool:
    return c in " \t\n\v\f\r"


def buckets(text: str, orders: tuple[int, ...], bits: int, inside) -> list[int]:
    """The bucket of each n-gram of a text between two borders; an n-gram may begin or end with a border."""
    chars = f"\n{text}\n"
    held_in = [inside(c) for c in chars]
    value = [mix((ord(c) * int(common.BASE) if i else 0) + 7 & BITS64) for c, i in zip(chars, held_in, strict=True)]
    out = []
    for start in range(len(chars)):
        held = 0
        for k in range(1, max(orders) + 1):
            if start + k > len(chars):
                break
            held = held * int(subwords.STEP) + value[start + k - 1] & BITS64
            part = held_in[start : start + k]
            fits = part[0] if k == 1 else any(part) if k == 2 else all(part[1:-1])
            if fits and k in orders:
                out.append(mix(held + k & BITS64) >> (64 - bits))
    return out
