"""Names looked up inside texts, in time that follows the text."""

from collections import Counter


class Names:
    """A set of names; ``within`` finds those that a text contains anywhere, also inside longer words.

    A text is asked for its parts that are as long as some name, so a look-up does not grow with
    the number of names.
    """

    def __init__(self, names=()):
        self._held, self._lengths = {}, Counter()
        for name in names:
            self.add(name)

    def add(self, name: str):
        if name not in self._held:
            self._held[name] = True
            self._lengths[len(name)] += 1

    def remove(self, name: str):
        if self._held.pop(name, None):
            self._lengths[len(name)] -= 1
            if not self._lengths[len(name)]:
                del self._lengths[len(name)]

    def __len__(self):
        return len(self._held)

    def within(self, text: str) -> set[str]:
        if len(self._held) <= 4:
            return {name for name in self._held if name in text}
        held = self._held
        return {part for n in self._lengths for i in range(len(text) - n + 1) if (part := text[i:i + n]) in held}
