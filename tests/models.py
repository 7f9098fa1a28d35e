"""Plain sequential models that the distributed operators must equal."""

MAX_LINE_GAP = 50


def greedy_clusters(hits, window_ms, burst_min):
    """hits: (line, ms) in line order -> line lists of the clusters that are kept."""
    clusters = []
    for line, ms in hits:
        if clusters:
            anchor_ms, members = clusters[-1]
            if anchor_ms == 0 and ms == 0:
                fits = line - members[-1] <= MAX_LINE_GAP
            else:
                fits = ms - anchor_ms <= window_ms
            if fits:
                members.append(line)
                continue
        clusters.append((ms, [line]))
    return [members for _, members in clusters if len(members) >= burst_min]


class Dictionary:
    """Templates mined one message at a time."""

    def __init__(self, threshold, cap):
        self.threshold, self.cap, self.templates = threshold, cap, []

    def _best(self, toks):
        bucket = [
            t for t in self.templates if len(t) == len(toks) and t.first == (toks or ["<empty>"])[0]
        ]
        scored = [(t.score(toks), -i, t) for i, t in enumerate(bucket)]
        best = max(scored, default=(-1.0, 0, None), key=lambda s: s[:2])
        return best[2] if best[0] >= self.threshold else None, len(bucket)

    def add(self, text):
        toks = text.split()
        found, size = self._best(toks)
        if found is not None:
            found.widen(toks)
        else:
            words = toks if size < self.cap else ["<*>"] * len(toks)
            self.templates.append(_Template(words, (toks or ["<empty>"])[0]))

    def match(self, text):
        found, _ = self._best(text.split())
        return None if found is None else self.templates.index(found)


class _Template:
    def __init__(self, words, first):
        self.words, self.first = list(words), first

    def __len__(self):
        return len(self.words)

    def score(self, toks):
        if not toks:
            return 1.0
        return sum(w in ("<*>", t) for w, t in zip(self.words, toks)) / len(toks)

    def widen(self, toks):
        self.words = [w if w == t else "<*>" for w, t in zip(self.words, toks)]
