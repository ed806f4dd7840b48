"""Vocabulary of the extraction rules, in alphabetical order."""

from __future__ import annotations


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


ABBREVIATIONS = _words(
    """
    am approx co dept dr e.g est etc fig i.e inc jr ltd mr mrs ms no pm prof sr st vol vs
    """
)

IMPERATIVES = _words(
    """
    add adjust aim allow alternate apply ask avoid bake begin book breathe bring call check choose clean close
    combine consider consult contact cook cool disable discover do don't dont download drink eat enable end
    enjoy ensure explore find focus hold hydrate include incorporate increase install invest join keep let lie
    lift limit look make measure mix monitor note open opt pack pick place plan practice prepare pull push put
    reach read reduce register relax remember repeat replace rest review rotate run save schedule see select
    serve set share sign sit speak spend stand start stay store stretch swap take talk tell track try use
    visit walk warm wash wear write
    """
)

AUXILIARIES = _words(
    """
    'll 'm 're 's 've am are be been being ca did do does get gets got had has have is was were will wo
    """
)

VERBS = _words(
    """
    accept accepted adopt adopted applied apply ate attend attended began begin book booked bought build built
    buy buying buys call called change changed choose chose cook cooked decide decided drank drink drive
    driving drove earn earned eat enjoy enjoyed finish finished flew fly found founded graduate graduated grew
    grow growing hate hated hire hired join joined keep kept launch launched lead learn learned learnt leave
    led left like liked likes live lived lives living love loved loves made make making manage managed married
    marry meet met move moved moving name named need needed order ordered own owned owns paid pay pick picked
    plan planned planning play played playing prefer preferred prefers quit raise raised ran read reject
    rejected retire retired run running save saved sell sign signed sold spend spent start started starting
    stop stopped studied study studying switch switched take taking taught teach took train trained training
    travel traveled travelled use used visit visited volunteer volunteered want wanted work worked working
    works write wrote
    """
)

LEADING_STOPS = _words(
    """
    a actually also an and but just so the then well
    """
)

ONE_VALUE = _words(
    """
    attend commute drive graduate live major marry move name own rent retire study weigh work
    """
)

OBJECT_STOPS = _words(
    """
    a about also an and any at been being but by for from her his in into it its just more my of on our quite
    really some that the their them these this those to very with your
    """
)

CORRECTION_STOPS = _words(
    """
    about after been before could from have should that their there this what when which with would было быть
    когда потому того тоже чтобы этом этот
    """
)

QUESTION_STOPS = _words(
    """
    a am an and are at be been did do does for had has have how i in is it me my of on or s t that the this to
    was were what when where which who whom whose why with you
    """
)

RECALL_STOPS = _words(
    """
    about again all also and any are be been being but can could did do does done for from give had has have
    here how into is its just know made make many may might more most much must need not now only our over
    please shall should show some take tell that the their then there these think this those under use used
    using very want was were what when where which who whom whose why will with would your был была были быть
    взять где давай дай дальше дать делать думаю есть зачем знаешь знаю использовать как какая какие какого
    какое какой каком когда которая которые который кто ладно можно надо нужно очень поехали пожалуйста покажи
    показать почему привет сделай сделать сейчас спасибо та там те теперь тот тут хорошо хочешь хочу чего чему
    что эта эти это этот
    """
)
