"""Small graphs that several tests share."""

RS = "http://www.w3.org/2001/sw/DataAccess/tests/result-set#"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _solution(*pairs: tuple[str, str]) -> str:
    return " , ".join(f'[ rs:value {value} ; rs:variable "{name}" ]' for name, value in pairs)


#: A result-set document: two solutions of four bindings each, and a second, empty result set.
RESULT_SET = f"""
@prefix : <http://example/> .
@prefix rs: <{RS}> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
<http://resultset/> a rs:ResultSet ;
  rs:resultVariable "p" , "g" , "s" , "o" ;
  rs:solution [ rs:binding {_solution(("s", ":x"), ("p", ":p"), ("g", "<data-g1.ttl>"), ("o", '"1"^^xsd:integer'))} ] ;
  rs:solution [ rs:binding {_solution(("s", ":a"), ("p", ":p"), ("o", '"9"^^xsd:integer'), ("g", "<data-g1.ttl>"))} ] .
"""
SECOND_SET = f"<http://resultset2/> a <{RS}ResultSet> ."

JOIN = '<r1> <p1> <r2> . <r2> <p1> <r1> . <r2> <p2> "l2" . <r1> <p2> "l1" .'
FILTER = "<r2> <p1> <r1> . <r1> <p1> " + " , ".join(f'"l{i}"' for i in range(1, 7)) + " ."
PATTERN = '<r2> <p2> <r1> . <r1> <p1> "l1" , "l3" , "l4" , "l6" . <r1> <p2> "l2" , "l5" .'
