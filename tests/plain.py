"""Rules in plain Python, written from their description."""


def best_window(text, terms, longest=200, size=30):
    """A short text's start, or the first of the windows with most terms in it, windows ending before the last word."""
    w = (text or "").split()
    if len(w) <= longest // 5:
        return (text or "")[:longest]
    shown = {i: " ".join(w[i : i + size]) for i in range(len(w) - size)}
    best = min(shown, key=lambda i: (-len([t for t in terms if t in shown[i].lower()]), i))
    return f"{'...' * (best > 0)}{shown[best]}{'...' * (best + size < len(w))}"[:longest]
