"""Answers labelled by hand, on which the cutoffs of the label model are validated.

Each is (answer, finish reason, question, letters of the prompt, defects). They were written for this purpose from the definitions of the
defects; none is a row of a table. The tests hold another set that no cutoff has seen.
"""

from __future__ import annotations

_Q = "Which vehicles show the lowest unit cost handled by Tolwick Branmere and with a length of 310 or more?"
_R = "by how much did the fuel cost of XABCD exceed 51820 in 2011?"
_G = "Wie viele Einträge in albums gehören zu Rolvik Sundgate und haben einen Wert von fee über 42?"
_S = "¿Cuál es el promedio de salary en players para Dorwin Castell cuando la edad no supera 30?"
_P = "tablesofthedatabasecreatetablevehiclesunitcostreallengthrealhintnonequestionwhichvehiclesshowthelowestunitcosthandledbytolwickbranmereandwithalengthof310ormoreworkinshortsteps"
_SQL = "SELECT MIN(unit_cost) FROM vehicles WHERE owner_name = 'Tolwick Branmere' AND length >= 310"

ANSWERS: tuple[tuple[str | None, str | None, str, str, frozenset[str]], ...] = tuple(
    (text, finish, question, prompt, frozenset(found.split()))
    for text, finish, question, prompt, found in (
        # sound answers
        (f"```sql\n{_SQL};\n```", "stop", _Q, "", ""),
        (f"First keep the rows that match the name, then sort them by cost.\n\n{_SQL}", None, _Q, _P, ""),
        (f"Sorry for the detour, I can't see an index here, but none is needed.\n```\n{_SQL}\n```", "stop", _Q, "", ""),
        (f"{_Q} Here is the query.\n```sql\n{_SQL}\n```", "stop", _Q, _P, ""),
        ("<think>\nThe change is small.\n</think>\nThe cost rose in that year.\nAnswer: 1,250", "stop", _R, "", ""),
        ("The table gives both years.\n**Answer:** -$ 31.5 %", "stop", _R, "", ""),
        ("Answer: yes", "stop", _R, "", ""),
        ("12.5", None, _R, "", ""),
        ('```json\n{"answer": "no", "unit": "count"}\n```', "stop", _R, "", ""),
        ("Unfortunately the page has two columns, but the later one is meant.\nAnswer: 77", "stop", _R, "", ""),
        ("Die Frage braucht die Tabelle albums, gefiltert nach dem Namen und der Gebühr.\n```sql\nSELECT COUNT(*) FROM albums WHERE fee > 42\n```", "stop", _G, "", ""),
        ("La pregunta necesita la tabla players, filtrada por la edad.\nSELECT AVG(salary) FROM players WHERE age <= 30", "stop", _S, "", ""),
        ("WITH x AS (SELECT unit_cost FROM vehicles) SELECT MIN(unit_cost) FROM x", None, _Q, _P, ""),
        # nothing in them
        (None, "stop", _Q, "", "empty"),
        ("", None, _R, "", "empty"),
        (" \n\t ", "stop", _Q, "", "empty"),
        ("```sql\n\n```", "stop", _Q, "", "empty"),
        ("<think>\n\n</think>", "stop", _R, "", "empty"),
        ("---\n<br/><p></p>", None, _R, "", "empty"),
        ("...", "length", _R, "", "empty truncated"),
        # broken off
        (f"```sql\n{_SQL}\n```", "length", _Q, "", "truncated"),
        ("Both years are listed.\nAnswer: 451", "length", _R, "", "truncated"),
        ("First keep the rows of vehicles that", "stop", _Q, "", "truncated"),
        ("The cost is listed for both years. Only the later one counts.", "stop", _R, "", "truncated"),
        ("We compare the length with the bound. Then", "length", _Q, _P, "truncated"),
        ("SELECT MIN(unit_cost) FROM vehicles WHERE owner_name =", "stop", _Q, "", "truncated"),
        ("Sort them by cost.\n```sql\nSELECT MIN(unit_cost) FROM vehicles WHERE length >=", "stop", _Q, "", "truncated"),
        ("```sql\nSELECT MIN(unit", "length", _Q, "", "truncated"),
        ("<think>\nThe fuel cost rose by", None, _R, "", "truncated"),
        ("<think>\nThe name is stored in owner_name, so a filter is enough", "length", _Q, "", "truncated"),
        ("Unfortunately the table has two similar columns, and only the", "stop", _Q, "", "truncated"),
        ("I apologize for the length of this. The professional way is to sum the", "length", _R, "", "truncated"),
        ('{"sql": "SELECT MIN(unit_cost) FROM', "length", _Q, "", "truncated"),
        ("La pregunta necesita la tabla players, y luego se", "stop", _S, "", "truncated"),
        # declined
        ("I'm sorry, but I cannot help with this request.", "stop", _Q, "", "refusal"),
        ("I must decline to answer this.", "stop", _R, "", "refusal"),
        ("That falls outside of what I can do. Please ask a professional.", None, _R, "", "refusal"),
        ("Regrettably, this is nothing that I do. A specialist knows more about this sensitive matter.", "stop", _Q, "", "refusal"),
        ("Sorry, it is better that somebody else takes this one. Perhaps try rephrasing it.", "stop", _R, "", "refusal"),
        ("Unfortunately such a request conflicts with the guidelines that I follow.", "stop", _Q, "", "refusal"),
        ("<think>\nIs this allowed?\n</think>\nNo answer will be given to this question.", "stop", _Q, "", "refusal"),
        ("Leider darf ich diese Frage nicht beantworten.", "stop", _G, "", "refusal"),
        ("Lo siento, no puedo responder a esta pregunta.", "stop", _S, "", "refusal"),
        # the question again
        (_Q, "stop", _Q, _P, "copy"),
        (f"The question was: {_Q}", "stop", _Q, "", "copy"),
        (f"> {_R}\n", "stop", _R, "", "copy"),
        (f"{_G}\n\n{_G}", "stop", _G, "", "copy"),
        (f"Tables of the database:\nCREATE TABLE vehicles (unit_cost REAL, length REAL)\n\nHint: none\n\nQuestion: {_Q}\n\nWork in short steps", "stop", _Q, _P, "copy"),
        (_S.upper(), None, _S, "", "copy"),
        # in another language
        (f"Die Frage braucht die Tabelle vehicles, und dann wird nach den Kosten sortiert.\n```sql\n{_SQL}\n```", "stop", _Q, "", "language"),
        ("Le tableau donne la valeur pour les deux années, et la différence est petite.\nAnswer: 12", "stop", _R, "", "language"),
        ("両方の年の値を比べて、その差を計算します。\nAnswer: 12", "stop", _R, "", "language"),
        ("Сначала сравниваю оба года, затем считаю разницу.\nAnswer: 12", None, _R, "", "language"),
        ("Vertailen ensin molempia vuosia ja lasken erotuksen.\nAnswer: 12", "stop", _R, "", "language"),
        ("Tabulka uvádí hodnotu pro oba roky, rozdíl počítám nakonec.\nAnswer: 12", "stop", _R, "", "language"),
        ("Then apply the condition on fee and count the rows that are left.\nSELECT COUNT(*) FROM albums WHERE fee > 42", "stop", _G, "", "language"),
        ("Först behåller jag bara raderna som passar till namnet.\nSELECT AVG(salary) FROM players WHERE age <= 30", "stop", _S, "", "language"),
    )
)
