"""Languages told apart by their function words and scripts."""

from __future__ import annotations

import re

#: Frequent function words of each language.
FUNCTION_WORDS: dict[str, frozenset[str]] = {
    "en": frozenset("our per used a about after all already also an and are as at be because been before but by can cannot each every first for from has have here how i if in into is it its left many more my no not of off on one only or out over so than that the their them then there these they this those to two under until was we were what when where which while who whose why will with without would you your".split()),
    "de": frozenset("aber alle als am an auf aus bei beide bis da dabei damit danach dann das dass dem den der des die diese diesem diesen dieser dieses durch ein eine einem einen einer eines er es fehlt für gibt haben hat hier ich im in ist jeder kann kein keine man mit muss nach nicht nichts noch nur oder ohne schon sehr sein sich sie sind so über um und unter vom von vor war warum was weg weil welche welcher wenn werden wie wird wir wurde zu zum zur zuerst zwei zwischen".split()),
    "es": frozenset("al antes aquí así aunque bien cada como con cual cuando cuál cuántos de del desde después donde dos el ella en entre era es esta este esto está fue hace hacia hasta hay la las le les lo los luego más mi muy ni no nos o otra otro para pero por porque primero que quien qué se según ser si sin sobre solo su sus también te tiene tienen todo todos tu un una unas uno unos y ya".split()),
    "fr": frozenset("au aucune aussi autre aux avant avec avoir bien car ce ces cet cette chaque combien comme d dans de des deux donc du déjà elle en encore ensuite entre est et eux fait font il ils j je l la le les leur lorsque mais me mes moins même n ne nous on ont ou où par pas plus pour puis qu quand que quel quelle qui s sa sans se ses si son sont sous sur tous tout trop très un une vers vous à été était".split()),
    "it": frozenset("a ad al alla alle anche anno ciò che chi ci come con cui da dai dal dalla degli dei del della delle dello di dopo dove due e ed era essere fino gli ha hanno i il in la le lo loro ma mentre nei nel nella nessuna nessun non o ogni per perché più poi prima qual quale quando quanti quanto quella quello questa questo si sia sono sotto sua sul sulla suo sopra tra tutti un una uno è".split()),
    "pt": frozenset("a ao aos as até cada com como da das de depois do dos e ela ele em entre era essa esse esta este está foi há isso já lhe mais mas mesmo muito na nas nem no nos não o os ou para pela pelo por porque primeiro qual quando que quem se sem ser seu sua são também tem todos um uma à é".split()),
    "pl": frozenset("a aby ale bez bo być był była było być by co czy dla do gdy gdzie go i ich ile jak jako jest już każdy które którego która który lub ma mają może na nad najpierw nie niż o obu od on oraz po pod potem przed przez przy są się ta tak tej ten tego to tu tylko tym u w więc wszystkie z za ze że żadne".split()),
    "nl": frozenset("aan al alle als bij dan dat de deze die dit door een eerst en er geen had heb heeft het hier hoe ik in is je kan maar meer met moet na naar niet nog nu of om omdat ook op over te tot uit van veel voor waar wanneer want wat wel welke wij wordt ze zich zijn zo zonder".split()),
}
#: The languages in which a word is a function word.
LANGUAGES_OF: dict[str, list[str]] = {}
for _lang, _known in FUNCTION_WORDS.items():
    for _word in _known:
        LANGUAGES_OF.setdefault(_word, []).append(_lang)
_SCRIPTS = re.compile("[Ͱ-Ͽ]|[Ѐ-ԯ]|[֐-׿]|[؀-ۿ]|[ऀ-ॿ]|[฀-๿]|[぀-ヿ㐀-鿿]|[가-힯]")


def hits(words: set[str]) -> dict[str, int]:
    """How many function words of each language occur."""
    found = dict.fromkeys(FUNCTION_WORDS, 0)
    for word in words:
        for lang in LANGUAGES_OF.get(word, ()):
            found[lang] += 1
    return found


def foreign_script(text: str) -> int:
    """Letters of scripts other than Latin."""
    return 0 if text.isascii() else len(_SCRIPTS.findall(text))


def language(text: str, words: set[str]) -> str | None:
    """The language with the most function words, 'other' for another script, None when that isn't clear."""
    if foreign_script(text) * 2 > sum(map(len, words)):
        return "other"
    (first, n), (_, m) = sorted(hits(words).items(), key=lambda x: -x[1])[:2]
    return first if n > m else None
