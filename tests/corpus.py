"""Queries over the fixture, each with its rows in order, the code that refuses it, or as no query at all."""

# The language's acceptance table.
CORPUS = [
    ('X where X = test.Foo _', 'rows', 'test.Foo#1; test.Foo#2; test.Foo#3'),
    ('X where test.Foo {name = X}', 'rows', 'ann; bob; ann'),
    ('{a = X, b = Y} where test.Foo {name = X, id = Y}', 'rows', '{a = ann, b = 1}; {a = bob, b = 2}; {a = ann, b = 3}'),
    ('X.name where X = test.Foo _', 'rows', 'ann; bob; ann'),
    ('X.value where X = test.Foo _', 'rows', 'one; two; three'),
    ('X.value where X = test.Boxed _', 'rows', '{lo = 10, hi = 20}; {lo = 30, hi = 40}'),
    ('X.value.lo where X = test.Boxed _', 'code', 'nyi/value-field'),
    ('X where test.Edge {from = X, to = Y}; test.Node {id = Y}', 'rows', '1; 1; 2'),
    ('X where test.Count X; X < 7', 'rows', '-9223372036854775808; -42'),
    ('X where test.Count X; X <= 7', 'rows', '-9223372036854775808; -42; 7'),
    ('X where test.Count X; X > -42', 'rows', '7; 1000'),
    ('X where test.Count X; 7 <= X', 'rows', '7; 1000'),
    ('X where test.Count X; X >= 7', 'rows', '7; 1000'),
    ('N where test.Name N; N > "ann"', 'rows', 'anna; bob'),
    ('{a = X, b = Y} where test.Edge {from = X, to = Y}; X < Y', 'rows', '{a = 1, b = 2}; {a = 1, b = 3}; {a = 2, b = 3}'),
    ('{a = X, b = Y} where test.Edge {from = X, to = Y}; X > Y', 'rows', ''),
    ('Y where test.Edge {from = X, to = Y}; test.Bar {id = Z}; Z < X', 'rows', '3'),
    ('N where test.Name N; N < 3', 'code', 'reject/type-mismatch'),
    ('X where X = test.Foo _; X < 3', 'code', 'reject/type-mismatch'),
    ('N where test.Name N; N < "a"..', 'code', 'reject/type-mismatch'),
    ('Y where test.Count X; Y = X + 1', 'rows', '-9223372036854775807; -41; 8; 1001'),
    ('Y where test.Count X; Y = X - 1', 'rows', '9223372036854775807; -43; 6; 999'),
    ('Y where test.Edge {from = A, to = B}; Y = A + B', 'rows', '3; 4; 5'),
    ('Y where test.Edge {from = A, to = B}; Y = A + B - 1', 'rows', '2; 3; 4'),
    ('Y where test.Ref {of = F}; Y = F.id + 100', 'rows', '101; 102'),
    ('Z where test.Count X; Y = X + 1; Z = Y + 1', 'rows', '-9223372036854775806; -40; 9; 1002'),
    ('X where test.Count X; Y = X + 1; Y > 8', 'rows', '1000'),
    ('N where test.Name N; Y = 1 + 1; Y > 5', 'rows', ''),
    ('Y where test.Name N; Y = N + 1', 'code', 'reject/type-mismatch'),
    ('Y where X = test.Foo _; Y = X + 1', 'code', 'reject/type-mismatch'),
    ('Y where test.Foo {id = X}; test.Bar {id = Y + 1}', 'code', 'nyi/value-match'),
    ('X where X = test.Foo _; X.value < "b"', 'code', 'nyi/value-match'),
    ('X where test.Nested {outer = {inner = X}}', 'rows', '1; 7'),
    ('X where X = test.Name "abc"..', 'rows', 'test.Name#1'),
    ('X where X = test.Count -42', 'rows', 'test.Count#2'),
    ('X where X = test.Count -9223372036854775808', 'rows', 'test.Count#1'),
    ('X where X = test.Count 1_000', 'rows', 'test.Count#4'),
    ('Y where Y = test.Foo _; test.Name Y.name', 'rows', 'test.Foo#1; test.Foo#2; test.Foo#3'),
    ('Y where Y = test.Foo _; test.Name (Y.name)', 'rows', 'test.Foo#1; test.Foo#2; test.Foo#3'),
    ('X where X = test.Foo _;', 'rows', 'test.Foo#1; test.Foo#2; test.Foo#3'),
    ('X where X = test.Foo {id = 1}', 'rows', 'test.Foo#1'),
    ('X where test.Foo {id = X, name = "ann"}', 'rows', '1; 3'),
    ('Y where test.Count Y', 'rows', '-9223372036854775808; -42; 7; 1000'),
    ('X where test.Ref {of = X}', 'rows', 'test.Foo#1; test.Foo#2'),
    ('P where P = test.Foo {id = 1}; test.Ref {of = P}', 'rows', 'test.Foo#1'),
    ('P where test.Ref {of = P}; P = test.Foo {id = 1}', 'rows', 'test.Foo#1'),
    ('P where P = test.Foo {id = 1}; test.Link {at = X, of = P}', 'rows', 'test.Foo#1'),
    ('X where X = test.Ref {of = test.Foo {id = 1}}', 'rows', 'test.Ref#1'),
    ('X where X = test.Deep {via = test.Ref {of = test.Foo {id = 1}}}', 'rows', 'test.Deep#1'),
    ('test.Bar {id = 1} where test.Foo _', 'rows', 'test.Bar#1; test.Bar#1; test.Bar#1'),
    ('X where test.Foo {id = X} | test.Bar {id = X}', 'rows', '1; 2; 3; 1; 2'),
    ('X where test.Foo {id = X}; !test.Bar {id = X}', 'rows', '3'),
    ('X where !test.Bar {id = X}; test.Foo {id = X}', 'rows', '3'),
    ('X where test.Foo {id = X}; !(test.Bar {id = X} | test.Edge {from = X, to = _})', 'rows', '3'),
    ('X where test.Bar {id = X}; !never', 'rows', '1; 2'),
    ('X where test.Foo {id = X}; !test.Edge {from = X, to = Y}', 'code', 'reject/unbound-variable'),
    ('X where test.Foo {id = X}; !(Y where test.Bar {id = Y})', 'code', 'nyi/negation'),
    ('P where P = test.Foo {id = 1}; !test.Ref {of = test.Foo {id = 2}}', 'code', 'nyi/negation'),
    ('X where X = (Y where test.Foo {id = Y})', 'rows', '1; 2; 3'),
    ('X.alt? where X = test.Foo _', 'code', 'reject/not-a-union'),
    ('X where test.Tagged {what = {num = X}, id = _}', 'rows', '1; 2'),
    ('X where test.Tagged {what = {text = X}, id = _}', 'rows', 'a; b'),
    ('X where test.Tagged {what = {num = _}, id = X}', 'rows', '10; 30'),
    ('X where test.Label {id = _, what = {num = X}}', 'rows', '1; 2'),
    ('Y where test.Label X; Y = X.what.num?', 'rows', '1; 2'),
    ('X.what.num? where test.Label X', 'rows', '1; 2'),
    ('X where test.Label {id = X, what = {num = 2}}', 'rows', '30'),
    ('X where test.Tagged {what = {nosuch = X}, id = _}', 'code', 'reject/unknown-alternative'),
    ('X where test.Tagged {what = {num = X, text = _}, id = _}', 'code', 'reject/union-arity'),
    ('X where X = never', 'rows', ''),
    ('Y where X = test.Foo _; Y = X.name', 'rows', 'ann; bob; ann'),
    ('Y where X = test.Foo _; Y = X.name; test.Name Y', 'rows', 'ann; bob; ann'),
    ('Y where test.Foo {name = X}; Y = X', 'rows', 'ann; bob; ann'),
    ('Y where X = test.Foo _; Y = X.value', 'rows', 'one; two; three'),
    ('X where test.Nested {outer = {inner = Y}}; X = {inner = Y}', 'code', 'nyi/value-bind'),
    ('Y where test.Ref {of = P}; Y = P.name', 'rows', 'ann; bob'),
    ('X where test.Foo {id = X}; test.Bar {id = Y}; X = Y', 'rows', '1; 2'),
    ('X where test.Name X; X = "a"..', 'rows', 'abc; ann; anna'),
    ('X where X = "a"..; test.Name X', 'rows', 'abc; ann; anna'),
    ('X where test.Foo {name = X}; X = "a"..', 'rows', 'ann; ann'),
    ('Y where X = test.Foo _; Y = X.name; Y = "a"..', 'rows', 'ann; ann'),
    ('X where X = "abc"; X = "z"..', 'rows', ''),
    ('X where test.Name X; X != "a"..', 'rows', 'bob'),
    ('X where X != "a"..; test.Name X', 'rows', 'bob'),
    ('X where test.Name X; X != "abc"', 'rows', 'ann; anna; bob'),
    ('X where test.Count X; X != 7', 'rows', '-9223372036854775808; -42; 1000'),
    ('X where test.Name X; X != "a"..; X != "b"..', 'rows', ''),
    ('X where test.Name X; X = "a"..; X != "an"..', 'rows', 'abc'),
    ('Y where X = test.Foo _; Y = X.name; Y != "a"..', 'rows', 'bob'),
    ('X where X = (Y where test.Name Y; Y != "a"..)', 'rows', 'bob'),
    ('X where X = (Y where test.Name Y; Y = "a"..)', 'rows', 'abc; ann; anna'),
    ('X where X = (Y where Y = test.Foo _)', 'rows', 'test.Foo#1; test.Foo#2; test.Foo#3'),
    ('X where X = (Y where Y = (Z where test.Name Z))', 'rows', 'abc; ann; anna; bob'),
    ('X where X = (Y where test.Count C; Y = C + 1)', 'rows', '-9223372036854775807; -41; 8; 1001'),
    ('X where X = "abc"; X != "a"..', 'rows', ''),
    ('X where X = "abc"; X != "z"..', 'rows', 'abc'),
    ('X where test.Foo {id = X}; !test.Bar {id = X}; X != 1', 'rows', '3'),
    ('X where X != "a"..', 'code', 'reject/unbound-variable'),
    ('X where test.Count X; X != "a"..', 'code', 'reject/type-mismatch'),
    ('P where P = test.Foo _; P != test.Foo _', 'code', 'nyi/bind-unification'),
    ('X where test.Foo {id = X}; test.Bar {id = Y}; X != Y', 'code', 'nyi/bind-unification'),
    ('X where test.Foo {id = X}; _ != 1', 'code', 'reject/bind-lhs'),
    ('X where X = {a = X}', 'code', 'reject/infinite-type'),
    ('X where X = test.Foo _; X.name != "a"..', 'code', 'nyi/bind-unification'),
    ('X where X = test.Foo _; X.value != "one"', 'code', 'nyi/bind-unification'),
    ('X where test.Foo {id = X} = test.Bar {id = X}', 'code', 'nyi/bind-unification'),
    ('X where Y = test.Foo _; Y.name = X', 'code', 'nyi/bind-unification'),
    ('X where P = test.Nested _; {inner = X} = P.outer', 'rows', '1; 7'),
    ('X where P = test.Wide _; {extra = _, inner = X} = P.outer', 'rows', '2'),
    ('X where {a = X} = {a = 1}', 'rows', '1'),
    ('X where test.Foo {id = X}; {a = X} = {a = Y}', 'code', 'nyi/value-bind'),
    ('_ where test.Foo _', 'code', 'reject/wildcard-in-head'),
    ('X where 42 = test.Foo _', 'code', 'reject/bind-lhs'),
    ('X.value where X = test.Shadow _', 'code', 'reject/value-shadowed'),
    ('X where test.Foo {name = X, name = Y}', 'code', 'reject/duplicate-field'),
    ('X where X = nosuch.Pred _', 'code', 'reject/unknown-predicate'),
    ('X where test.Foo {nosuch = X}', 'code', 'reject/unknown-field'),
    ('X where test.Foo {name = 42}', 'code', 'reject/type-mismatch'),
    ('X where test.Foo X.name', 'code', 'reject/unresolved-access'),
    ('X.value where X = test.Bar _', 'code', 'reject/no-value'),
    ('X where X = test.Count 1__0', 'code', 'lit/int-underscore'),
    ('X where X = test.Count 1_', 'code', 'lit/int-underscore'),
    ('X where X = test.Count 007', 'code', 'lit/int-leading-zero'),
    ('X where X = test.Count 99999999999999999999', 'code', 'lit/int-range'),
    ('X where X = test.Count 9223372036854775808', 'code', 'lit/int-range'),
    ('X where X = test.Name "\\uD800"', 'code', 'lit/string-escape'),
    ('X where X = 42', 'rows', '42'),
    ('Z where Z = 1; test.Bar {id = Z}', 'rows', '1'),
    ('Z where test.Bar {id = Z}; Z = 1', 'rows', '1'),
    ('X where X = {inner = 1}; test.Nested {outer = X}', 'rows', '{inner = 1}'),
    ('X where test.Nested {outer = X}; X = {inner = 1}', 'rows', '{inner = 1}'),
    ('{x = A.x, y = A.y} where A = {x = 2, y = 3}', 'rows', '{x = 2, y = 3}'),
    ('A.x where A = {x = 1}; test.Bar {id = A.x}', 'rows', '1'),
    ('{a = X, b = Z} where test.Edge {from = X, to = _}; Z = 7', 'rows', '{a = 1, b = 7}; {a = 1, b = 7}; {a = 2, b = 7}'),
    ('X.name where test.Ref {of = X}', 'rows', 'ann; bob'),
    ('X.value where test.Ref {of = X}', 'rows', 'one; two'),
    ('N where test.Deep {via = R}; N = R.of.name', 'rows', 'ann; bob'),
    ('{a = X.id, b = X.name} where test.Ref {of = X}', 'rows', '{a = 1, b = ann}; {a = 2, b = bob}'),
    ('P.id where test.Ref {of = P}; test.Bar {id = P.id}', 'rows', '1; 2'),
    ('Y where Y = test.Foo _; test.Name Y.value', 'code', 'nyi/value-match'),
    ('Y where test.Foo Y', 'rows', '{id = 1, name = ann}; {id = 2, name = bob}; {id = 3, name = ann}'),
    ('X where test.Foo _', 'code', 'reject/unbound-variable'),
    ('X where test.Edge {from = X, to = X}', 'code', 'nyi/repeated-variable'),
    ('X where X = test.Foo _; 42', 'code', 'reject/not-a-generator'),
    ('"abc".. where test.Foo _', 'code', 'reject/not-projectable'),
    ('where', 'syntax', ''),
    ('X where', 'syntax', ''),
    ('X where test.Foo', 'syntax', ''),
    ('X where X = }', 'syntax', ''),
]
