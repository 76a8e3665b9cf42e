"""Abusive, hateful or sexual content: votes of the nearest labelled examples.

Texts are cut into sentences. Labelled sentences are indexed by TF-IDF over words, pairs of words and character
n-grams; the index is inverted, its postings in blocks of labelled sentences with the greatest weight of each feature
in each block. For the sentences of a batch the blocks' bounds are computed first, and a block is scored, exactly,
only where its bound can still reach the K nearest (block-max pruning), so every sentence's score is exact. The votes of the nearest, weighted by similarity, give the
sentence's score, and the greatest of its sentences the document's, with that sentence and its nearest example as
evidence. A document's score depends on the labels alone, not on what other documents there are.

Disguises are undone before: compatibility forms, invisible characters, look-alike letters, digits for letters,
letters set apart, and words joined by underscores. A label belongs to a whole text, so each labelled sentence gets the
mean label of the texts it occurs in, and sentences that are near unflagged ones are outvoted. The reviewers' texts are
joined by a short list of our own in the corpus's languages. Null and empty texts score 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cyrillic and Greek letters that look like Latin ones, and digits and signs used for letters.
_LOOKS = str.maketrans("асеорхуіјѕһԁӏвмнткгαενορτυι", "aceopxyijshdlbmhtkraevoptui")
_LEET = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W_]+(?:\*+[^\W_]*)*")
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_]([ .\-_*|/]))(?:[^\W\d_]\1){2,}[^\W\d_](?![^\W_])")
_ENDS = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|(?<=[。！？])|(?<=[.!?])(?=[぀-ヿ一-鿿])|[\r\n]+|</?\w[^>\n]*>")
_CYR, _LAT = re.compile(r"[а-яёіјѕһԁӏ]"), re.compile(r"[a-z]")
_TWICE = re.compile(r"([^\W\d_])\1+")
#: Sentences longer than this many words are scored in overlapping windows of that many.
WINDOW = 40
K = 9


class _Kept(dict):
    """What becomes of a character: marks, and signs that aren't seen, go."""

    def __missing__(self, c: int) -> int | None:
        self[c] = got = None if unicodedata.category(chr(c)) in ("Mn", "Cf", "Cc", "Me") and chr(c) not in "\n\t" else c
        return got


_KEPT = _Kept()


def plain(text: str) -> str:
    """Lower case, compatibility forms resolved, invisible characters and accents left out, look-alikes and set-apart letters undone."""
    t = text
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
        t = t.translate(_KEPT)
        t = unicodedata.normalize("NFC", t)
    t = t.lower()
    if not t.isascii() and len(_LAT.findall(t)) > len(_CYR.findall(t)):
        t = t.translate(_LOOKS)
    elif not t.isascii():
        t = re.sub(r"[^\W_]*[a-z][^\W_]*", lambda m: m[0].translate(_LOOKS), t)
    return _APART.sub(lambda m: m[0].replace(m[1], ""), t)


_SIGNED, _INNER = re.compile(r"[@$!][a-z0-9]|[a-z0-9][@$]"), re.compile(r"(?<=[a-z0-9])[@$!](?=[a-z0-9])|[@$](?=[a-z])")
_DIGIT, _MIXED = re.compile(r"[013457]"), re.compile(r"(?=.*[a-z])(?=.*[013457])")


def words(sentence: str) -> list[str]:
    """The words of a plain sentence; digits inside words read as letters, as are single numbers in a sentence with such words."""
    if ("@" in sentence or "$" in sentence or "!" in sentence) and _SIGNED.search(sentence):
        sentence = _INNER.sub(lambda m: m[0].translate(_LEET), sentence)
    out = _WORD.findall(sentence)
    if not _DIGIT.search(sentence):
        return out
    mixed = [bool(_MIXED.match(w)) for w in out]
    n = sum(mixed)
    if not n:
        return out
    return [w.translate(_LEET) if m or n >= 2 and w.isdigit() and len(w) < 4 else w for w, m in zip(out, mixed)]


#: Lines of code: calls, assignments, blocks. They are no sentences unless they hold a comment.
_CODE = re.compile(r"[;{}]\s*$|\w\(|^\s*(?:if|for|while|elif|else|return|import|use|using|package|from|def|fn|func|var|let|const|val)\b[^.!?]*[:={(]|^\s*[\w.$]+\s*(?::=|[-+*/]?=|\+)\s*\S+\s*$|^\s*at \w+\.|^\s*(?:return|import|package|use|using|require)\b\s+\S+$")
_REMARK = re.compile(r"(?://|#|/\*|\*|--)\s*([^\W\d_].*)|\"([^\"]{12,})\"|'([^']{12,})'")
_PROSE = re.compile(r"[^\W\d_]+(?:[ ,]+[^\W\d_]+){4,}|[぀-ヿ一-鿿]{4,}")  # what code hardly has outside its remarks
_SIGNS = re.compile(r"[぀-ヿ一-鿿]")


def sentences(text: str) -> list[str]:
    """Plain sentences, long ones in windows that overlap by half; of a line of code each remark and literal, and the line itself only where it reads as prose."""
    out = []
    for s in _ENDS.split(plain(text)):
        s = (s or "").strip()
        if len(s) < 3:
            continue
        if _CODE.search(s):
            out += [x.replace("_", " ") for m in _REMARK.finditer(s) if (x := m[m.lastindex].strip()) and (not _CODE.search(x) or _PROSE.search(x))]
            if not _PROSE.search(s):
                continue
        w = s.replace("_", " ").split()
        if len(w) <= WINDOW:
            out.append(" ".join(w))
        else:
            out += [" ".join(w[k : k + WINDOW]) for k in range(0, len(w) - WINDOW // 2, WINDOW // 2)]
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_features(word: str) -> list[int]:
    """Hashes of a word's own features, repeated as often as they count: the word itself twice, and character n-grams; of scripts without blanks, pairs of characters."""
    w = _TWICE.sub(r"\1", word)  # stretched words
    own = _hash(w)
    if not w.isascii() and _SIGNS.search(w):
        return [own, own, *(_hash(w[i : i + 2]) for i in range(len(w) - 1))]
    p = f"<{w}>"
    return [own, own, *(_hash("~" + p[i : i + 4]) for i in range(len(p) - 3) if len(w) > 3)]


class Features:
    """The features of many token lists at once; those of a word are kept, as words repeat."""

    def __init__(self) -> None:
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, feature, count), each feature of a list once: of words and of pairs of words."""
        known = self.known
        if len(known) > 300_000:
            known.clear()
        flat = [w for t in lists for w in t]
        for w in {*flat} - known.keys():
            known[w] = np.array(word_features(w), dtype=np.uint64)
        if not flat:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float64)
        q = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
        own = [known[w] for w in flat]
        sizes = [len(x) for x in own]
        heads = np.fromiter((x[0] for x in own), dtype=np.uint64, count=len(own))
        same = q[1:] == q[:-1]
        pairs = (heads[:-1] * _A + heads[1:] * _B)[same]
        where = np.concatenate((np.repeat(q, sizes), q[1:][same]))
        what = np.concatenate((*own, pairs))
        order = np.argsort(_mix(what ^ (where.astype(np.uint64) * _B)))  # brings what is the same together
        where, what = where[order], what[order]
        first = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (what[1:] != what[:-1]))))
        return where[first], what[first], np.diff(np.append(first, len(where))).astype(np.float64)


def _rank(q: np.ndarray) -> np.ndarray:
    """The place of each among those with the same q, from 0; q is sorted."""
    return np.arange(len(q)) - np.searchsorted(q, q)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then the same for the next."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Index:
    """The inverted index of labelled sentences: the postings of each feature in order of the sentences, and the greatest weight of each
    feature in each block of sentences, both as flat arrays, so its size follows the postings."""

    def __init__(self, examples: list[tuple[list[str], float]], block: int = 32):
        self.block, self.tokens, self.features = block, [t for t, _ in examples], Features()
        self.label = np.array([y for _, y in examples], dtype=np.float64)
        n = self.size = len(examples)
        where, what, count = self.features(self.tokens)
        self.vocabulary, row, df = np.unique(what, return_inverse=True, return_counts=True)
        self.idf = np.log((n + 1) / (df + 0.5))
        self.unseen = math.log((n + 1) / 0.5)
        v = (1 + np.log(count)) * self.idf[row]
        v /= np.sqrt(np.maximum(np.bincount(where, weights=v * v, minlength=n), 1e-18))[where]
        order = np.lexsort((where, row))
        self.example, self.weight, row = where[order].astype(np.int32), v[order].astype(np.float32), row[order]
        # a piece is what a feature has in a block: its postings from at on
        in_block = self.example // block
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (in_block[1:] != in_block[:-1])))) if n and len(row) else np.zeros(0, np.int64)
        self.at = np.append(first, len(row))
        self.piece_block = in_block[first]
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.pieces = np.searchsorted(row[first], np.arange(len(self.vocabulary) + 1))
        self.blocks = -(-n // block)
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted({w for t, y in examples if y > 0.5 for w in t if w.isalpha()}):
            self.by_length[len(w)].append(w)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def unmask(self, tokens: list[str]) -> list[str]:
        """Words with letters starred out read as the flagged examples' word that fits."""
        if not any("*" in w for w in tokens):
            return tokens
        out = []
        for w in tokens:
            if "*" in w and re.search(r"[^\W_]", w):
                fit = re.compile(re.sub(r"\\\*", r"\\w", re.escape(w)) + r"\Z")
                loose = re.compile(re.sub(r"(?:\\\*)+", r"\\w+", re.escape(w)) + r"\Z")
                w = next((x for x in self.by_length.get(len(w), []) if fit.match(x)), None) or next((x for k in self.by_length.values() for x in k if loose.match(x)), w)
            out.append(w)
        return out

    def nearest(self, lists: list[list[str]], leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, example, cosine) of the K nearest labelled sentences of each list, exact; leave names an example that each list passes over.

        The bound of a block is the sum of its greatest weights, so no cosine in it is above. The two blocks of the greatest bounds
        are scored first; others only where their bound reaches the K-th best cosine found in these.
        """
        out = []
        step = max(1, 6_000_000 // max(1, self.blocks * self.block))
        for k in range(0, len(lists), step):
            q, j, s = self._nearest(lists[k : k + step], None if leave is None else leave[k : k + step])
            out.append((q + k, j, s))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)

    def _weighted(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, row, weight) of the known features; the weights of a list, with those unknown, have length 1."""
        where, what, count = self.features(lists)
        row = np.minimum(np.searchsorted(self.vocabulary, what), max(len(self.vocabulary) - 1, 0))
        seen = self.vocabulary[row] == what if len(self.vocabulary) else np.zeros(len(what), dtype=bool)
        v = (1 + np.log(count)) * np.where(seen, self.idf[row] if len(self.idf) else 0.0, self.unseen)
        norm = np.sqrt(np.bincount(where, weights=v * v, minlength=len(lists)))
        return where[seen], row[seen], (v / norm[where])[seen]

    def _nearest(self, lists: list[list[str]], leave: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(lists)
        where, row, v = self._weighted(lists)
        # the pieces that the lists' features have in the blocks
        size = self.pieces[row + 1] - self.pieces[row]
        piece, q, v = _ranges(self.pieces[row], size), np.repeat(where, size), np.repeat(v, size)
        cell = q * self.blocks + self.piece_block[piece]
        bound = np.bincount(cell, weights=v * self.most[piece], minlength=n * self.blocks)
        best = np.argsort(-bound.reshape(n, self.blocks), axis=1)[:, :2] if self.blocks else np.zeros((n, 0), np.int64)
        chosen = np.zeros(n * self.blocks, dtype=bool)
        chosen[(np.arange(n)[:, None] * self.blocks + best).ravel()] = True
        got = self._scored(chosen, cell, piece, v, self.blocks, leave)
        least = np.zeros(n)
        kth = _rank(got[0]) == K - 1
        least[got[0][kth]] = got[2][kth]
        more = (bound > 0) & (bound >= np.repeat(least, self.blocks) - 1e-6) & ~chosen
        if more.any():
            rest = self._scored(more, cell, piece, v, self.blocks, leave)
            got = self._sorted(*[np.concatenate(x) for x in zip(got, rest)])
        return tuple(x[_rank(got[0]) < K] for x in got)

    def _scored(self, chosen: np.ndarray, cell: np.ndarray, piece: np.ndarray, v: np.ndarray, blocks: int, leave: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number = np.cumsum(chosen) - 1
        cells = np.flatnonzero(chosen)
        on = chosen[cell]
        cell, piece, v = cell[on], piece[on], v[on]
        size = self.at[piece + 1] - self.at[piece]
        post = _ranges(self.at[piece], size)
        slot = np.repeat(number[cell] * self.block, size) + self.example[post] % self.block
        s = np.bincount(slot, weights=np.repeat(v, size) * self.weight[post], minlength=len(cells) * self.block)
        at = np.flatnonzero(s > 0)
        q, j, s = cells[at // self.block] // blocks, cells[at // self.block] % blocks * self.block + at % self.block, s[at]
        if leave is not None:
            keep = j != leave[q]
            q, j, s = q[keep], j[keep], s[keep]
        return self._sorted(q, j, s)

    @staticmethod
    def _sorted(q: np.ndarray, j: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((j, -s, q))
        return q[order], j[order], s[order]

    def masses(self, lists: list[list[str]], leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(votes for flagged, votes for not flagged, the example of the greatest vote for flagged), each vote the square of the cosine."""
        q, j, s = self.nearest(lists, leave)
        yes, no = (np.bincount(q, weights=s * s * y, minlength=len(lists)) for y in (self.label[j], 1 - self.label[j]))
        for_it = s * s * self.label[j]
        order = np.lexsort((j, -for_it, q))
        example = np.full(len(lists), -1)
        first = order[np.flatnonzero(np.diff(q[order], prepend=-1))]
        example[q[first]] = j[first]
        return yes, no, example

    def scores(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(score, nearest flagged example) of each list: the share of the votes for flagged, with a small vote of nobody against.

        Every score is exact, whether it reaches the threshold or not.
        """
        words_of = np.array([sum(len(w) // 2 if not w.isascii() and _SIGNS.search(w) else 1 for w in t) for t in lists])
        nobody = np.where(words_of < LEAST, NOBODY_SHORT, NOBODY)
        yes, no, example = self.masses(lists)
        return yes / (yes + no + nobody), example


#: The weight of the vote that nobody casts: sentences that are like no example stay unflagged. In a sentence of fewer than LEAST words (two
#: characters of scripts without blanks are one) a single word makes the cosine, so that vote weighs more.
NOBODY, NOBODY_SHORT, LEAST = 0.04, 0.6, 5
#: Votes against a label, from sentences of other texts, that may outweigh it.
CLEAN = 0.25
#: A document of at least this score counts as offending.
THRESHOLD = 0.5
#: At most so many labelled texts are indexed; the index is broadcast and must not be larger than that.
EXAMPLES, MOST_BYTES = 20_000, 256 << 20


#: Examples of our own, judged like the reviewers' texts, as those are in few of the corpus's languages and don't show every
#: kind: insults, threats, contempt of groups and explicit content, by language; and what is none of it.
OWN_FLAGGED = {
    "en": "You are an idiot. You are so stupid it hurts. Shut up, you moron, nobody wants to hear from you. Get lost, you piece of trash. Your family must be ashamed of you. A monkey does better work than you. You are a waste of space."
    " I know where you live and I will hurt you. Go kill yourself. I will break your legs. Someone should beat you up. Women are too dumb to do this job. Gays are disgusting and should be locked up. Immigrants are vermin, throw them out."
    " These people are animals and belong in cages. Free porn videos, watch naked girls now. Uncensored xxx clips, click here. I want to have sex with you. I dream of your naked body. Send me nudes, I am horny.",
    "de": "Du bist ein Idiot. Halt die Klappe, du Versager. Verpiss dich, du Stück Dreck. Leute wie du sind eine Schande. Ich weiß, wo du wohnst, und breche dir die Beine. Bring dich um. Frauen sind zu blöd für diese Arbeit."
    " Ausländer sind Abschaum und sollen verschwinden. Schwule gehören weggesperrt. Gratis Pornos mit nackten Frauen, hier klicken. Ich will mit dir schlafen, schick mir Nacktfotos.",
    "fr": "Tu es un imbécile. Ferme ta gueule, pauvre con. Dégage, espèce d'ordure. Tes parents doivent avoir honte de toi. Je sais où tu habites et je vais te frapper. Va te suicider. Les femmes sont trop bêtes pour ce travail."
    " Les immigrés sont des parasites, qu'on les chasse. Les homosexuels sont répugnants. Vidéos porno gratuites avec des filles nues, clique ici. J'ai envie de coucher avec toi, envoie des photos nues.",
    "es": "Eres un idiota. Cállate, imbécil, nadie te quiere oír. Lárgate, pedazo de basura. Das vergüenza a tu familia. Sé dónde vives y te voy a romper las piernas. Ojalá te mueras. Las mujeres son demasiado tontas para este trabajo."
    " Los inmigrantes son una plaga, hay que echarlos. Los gays dan asco. Videos porno gratis con chicas desnudas, haz clic aquí. Quiero acostarme contigo, mándame fotos desnuda.",
    "pt": "Você é um idiota. Cala a boca, imbecil, ninguém quer te ouvir. Some daqui, seu lixo. Sua família deve ter vergonha de você. Sei onde você mora e vou quebrar suas pernas. Se mata logo. As mulheres são burras demais para este trabalho."
    " Os imigrantes são uma praga e devem ser expulsos. Os gays são nojentos. Vídeos pornô grátis com mulheres nuas, clique aqui. Quero transar com você, manda fotos pelada.",
    "ru": "Ты идиот. Заткнись, придурок, тебя никто не спрашивал. Убирайся отсюда, мразь. Твои родители должны тебя стыдиться. Я знаю, где ты живёшь, и переломаю тебе ноги. Сдохни, тварь. Женщины слишком глупы для этой работы."
    " Мигранты паразиты, гнать их отсюда. Геи отвратительны. Бесплатное порно, голые девушки, жми сюда. Хочу секса с тобой, пришли голые фото.",
    "ja": "お前は馬鹿だ。黙れ、クズ。消えろ、ゴミ野郎。お前の家を知っている、殺してやる。死ね。女は頭が悪いからこの仕事は無理だ。外国人は害虫だから追い出せ。無料エロ動画、裸の女の子を見る。君とセックスしたい、裸の写真を送って。",
    "zh": "你是个白痴。闭嘴,蠢货,没人想听你说话。滚开,你这个垃圾。我知道你住在哪里,我要打断你的腿。你去死吧。女人太笨,做不了这种工作。外国人都是害虫,应该赶出去。免费色情视频,裸体美女,点击观看。我想和你上床,发裸照给我。",
}
OWN_OTHERS = {
    "en": "I strongly disagree with your solution. Your patch is wrong, please read the review. This bug is stupid and cost me a day. Kill the process and start the server again. You are right, it was my mistake. The sex of the patient is optional."
    " Messages that insult people are removed. Thank you for your help. Do you know where the file lives? We should remove the dead code. A naked return is hard to read. Strip the symbols from the binary. The parent kills its children when it exits. The dirty pages are flushed. The slave follows its master.",
    "de": "Ich bin mit deiner Lösung nicht einverstanden. Dieser Fehler ist dumm. Danke für deine Hilfe. Weißt du, wo die Datei liegt? Beiträge, die andere beleidigen, werden gelöscht.",
    "fr": "Je ne suis pas d'accord avec ta solution. Ce bogue est stupide. Merci pour ton aide. Sais-tu où se trouve le fichier? Les messages qui insultent sont supprimés.",
    "es": "No estoy de acuerdo con tu solución. Este error es estúpido. Gracias por tu ayuda. ¿Sabes dónde está el archivo? Los mensajes que insultan se borran.",
    "pt": "Não concordo com a sua solução. Este erro é estúpido. Obrigado pela ajuda. Você sabe onde está o arquivo? As mensagens que insultam são apagadas.",
    "ru": "Я не согласен с твоим решением. Эта ошибка глупая. Спасибо за помощь. Ты знаешь, где лежит файл? Сообщения с оскорблениями удаляются.",
    "ja": "あなたの解決策には同意できません。このバグは馬鹿げている。ご協力ありがとうございます。ファイルの場所を知っていますか。",
    "zh": "我不同意你的方案。这个错误很蠢。谢谢你的帮助。你知道文件在哪里吗?",
}


def build(labels: list[tuple[str, int]]) -> Index:
    """The index of labelled texts. A sentence gets the mean label of its texts, but a label that the near sentences of
    other texts contradict is taken for that of another sentence of its text, or for an error."""
    votes: dict[str, list[float]] = defaultdict(list)
    for text, y in labels:
        for x in sentences(text or ""):
            if words(x):
                votes[x].append(float(y or 0))
    mean = {x: float(np.mean(v)) for x, v in votes.items()}
    for _ in range(3):
        names = sorted(mean, key=lambda x: (-mean[x], x))  # flagged ones share blocks
        lists = [words(x) for x in names]
        yes, no, _ = Index([(t, mean[x]) for t, x in zip(lists, names)]).masses(lists, np.arange(len(names)))
        new = dict(mean)
        for x, a, b in zip(names, yes, no):
            if b > CLEAN and a < b and not (len(votes[x]) >= 3 and np.mean(votes[x]) > 0.5):
                new[x] = 0.0  # near sentences of unflagged texts speak against it
            elif a > 2 * CLEAN and b < 0.35 * a and len(votes[x]) < 3 and mean[x] > 0:
                new[x] = 1.0
        mean = new
    for own, y in ((OWN_OTHERS, 0.0), (OWN_FLAGGED, 1.0)):
        mean.update({x: y for text in own.values() for x in sentences(text) if words(x) and x not in mean})
    names = sorted(mean, key=lambda x: (-mean[x], x))
    return Index([(words(x), mean[x]) for x in names])


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, score, sentence and example: for each document its greatest score with the evidence, 0 and null for others.

    labels needs text and flagged; at most EXAMPLES texts, chosen by a hash, are indexed. Each document is scored where it is read, its
    task's sentences together and each once; no text is shuffled.
    """
    rows = labels.where(F.col("text").isNotNull() & F.col("flagged").isNotNull()).orderBy(F.xxhash64("text"), "text", "flagged").limit(EXAMPLES).select("text", "flagged").collect()
    index = build([(r[0], int(r[1])) for r in rows])
    if index.nbytes() > MOST_BYTES:
        raise ValueError(f"an index of {index.nbytes()} bytes is too large to broadcast; lower EXAMPLES")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            number: dict[str, int] = {}
            of = [[number.setdefault(s, len(number)) for s in dict.fromkeys(sentences(t))] if t else [] for t in b.column("text").to_pylist()]
            lists = [ix.unmask(words(s)) for s in number]
            score, example = ix.scores(lists)
            best = [max(found, key=lambda k: (score[k], -k)) if found else -1 for found in of]
            hit = [k >= 0 and score[k] > 0 for k in best]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("source"), pa.array([float(score[k]) if h else 0.0 for k, h in zip(best, hit)], pa.float64()),
                    pa.array([" ".join(lists[k]) if h else None for k, h in zip(best, hit)], pa.string()),
                    pa.array([" ".join(ix.tokens[example[k]]) if h and example[k] >= 0 and ix.label[example[k]] > 0 else None for k, h in zip(best, hit)], pa.string()),
                ], names=["doc_id", "source", "score", "sentence", "example"])

    slim = docs.select("doc_id", "source", "text")
    kind = {f.name: f.dataType.simpleString() for f in slim.schema}
    scored = slim.mapInArrow(run, f"doc_id {kind['doc_id']}, source {kind['source']}, score double, sentence string, example string")
    # repeated rows once; only scores and evidence are shuffled
    return scored.groupBy("doc_id").agg(F.max(F.struct("score", "source", "sentence", "example")).alias("b")).select("doc_id", "b.source", "b.score", "b.sentence", "b.example")


def rates(scored: DataFrame) -> DataFrame:
    """source, documents, offending and rate, null sources together."""
    hit = F.sum((F.col("score") >= THRESHOLD).cast("long"))
    return scored.groupBy("source").agg(F.count("*").alias("documents"), hit.alias("offending"), (hit / F.count("*")).alias("rate"))
