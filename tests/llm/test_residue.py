import pytest

from folio_spark.llm import residue as R

SLOTS = ["{{name}}", "{{ name }}", "[[contact]]", "[[% period %]]", "<%= client %>", "<<amount>>", "${amount}", "#{site}", "{0} (site)", "{company_name}", "@@DATE@@", "XXCLIENTXX", "__PROJECT__", "%PERIOD%", "<insert amount>", "[INSERT AMOUNT]", "[site TBD]", "[your date here]", "[Projekt: ____]", "«amount»"]


@pytest.mark.parametrize("slot", SLOTS)
def test_slots(slot):
    assert R.residue(f"Dear {slot}, thank you for your order. The budget was approved in June.") == "slot"


@pytest.mark.parametrize("text", [None, "", "  ", "The manual explains that a marker such as `{{name}}` is replaced by the merge step.", "In the shell example, ${HOME} and %PATH% are variables that are filled in at run time.", "The set {A, B, 8} denotes the stations.", "Square brackets such as [sic] or [14] mark notes.", "```\nHello {{name}}\n```\nThis is how it looks.", "El mensaje «Acceso denegado» apareció 3 veces en la sala."])
def test_texts_about_slots_are_left_alone(text):
    assert R.residue(text) is None


def test_kinds():
    assert R.residue("404 Not Found\nThe address you entered does not exist on this server.") == "error"
    assert R.residue("Please enable JavaScript to view this content.") == "notice"
    assert R.residue("Bitte aktivieren Sie die Skriptausführung und laden Sie die Seite neu.") == "notice"
    assert R.residue("Type something here. Replace this paragraph with your own content.") == "filler"
    assert R.residue("text text text text text text text") == "filler"
    assert R.residue("Lorem ipsum " + "velant corpus nemora sagis umbra turpi rebus " * 4) == "filler"


@pytest.mark.parametrize("text, kind", [("401 Unauthorized", "error"), ("400 Bad Request", "error"), ("Etwas ist schief gegangen", "error"), ("Zur Startseite", "error"), ("Beispieltitel", "filler"), ("Die Anwendung dieses Anbieters benötigt für alle Bereiche der neuen Oberfläche und auch für sämtliche weiteren Ansichten der alten Oberfläche sowie für Ausdrucke und Berichte und Auswertungen der Abteilung eine aktive Ausführung von JavaScript.", "notice")])
def test_lines_are_read_whatever_words_they_hold(text, kind):
    assert R.residue(text) == kind


def test_every_line_pattern_has_its_literals():
    """A line can only match where a literal is that the pattern itself needs, so lines without one needn't be searched."""
    for kind, lines in {"error": ["Oops!", "HTTP 503", "Zugriff verweigert", "4xx? No: 404 – page introuvable"], "notice": ["Please allow JS here", "Aktivieren Sie JavaScript"], "filler": ["Lorem ipsum", "Dies ist ein Blindtext"]}.items():
        found = R.necessary(R._LINES[kind])
        for line in lines:
            assert R._LINES[kind].search(line) and any(x in line.lower() for x in found)
    with pytest.raises(ValueError):
        R.necessary(R.re.compile(r"\d+|abc"))


def test_a_heading_is_no_content():
    assert R.residue("9. Diversion: the freight team\nHome\nThis view needs scripts to go on, please enable JavaScript.") == "notice"
    assert R.residue("Annual report") is None and R.residue("Error handling\nThe new parser logs every line that it can't read.") is None


def test_slots_count_by_density():
    words = "the committee approved the budget of the year " * 150
    assert R.residue(words + "{{customer_name}}") is None
    assert R.residue(words + "{{customer_name}} " * 5) == "slot"
    assert R.residue("The set {a} is open.") is None


def test_numbers_of_pages_are_no_errors():
    assert R.residue("La carga aumentó hasta 17.426 páginas. Le retard atteint 50 442 pages.") is None


def test_reports_of_errors_are_content():
    text = "Every 404 answer is now logged with its referrer. Users reported the message “Access denied” 53 times. The viewer no longer requires JavaScript. " + "The committee approved the budget. " * 5
    assert R.residue(text) is None


def test_operator(spark):
    rows = [(1, "404 Not Found", 9), (1, "404 Not Found", 9), (2, None, 9), (3, "", 9), (None, "Please enable JavaScript.", 9), (4, "Fine text about {{budgets}}. " * 20000, 9), (5, "Fine text about budgets. " * 20000 + "{{slot}}", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind int")
    assert sorted((r.doc_id or 0, r.kind) for r in R.detect(docs).collect()) == [(0, "notice"), (1, "error"), (1, "error"), (4, "slot")]
    assert {r.doc_id for r in R.exclude(docs).collect()} == {2, 3, 5, None}
    assert R.detect(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
