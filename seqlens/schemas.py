"""Table shapes, declared once as DDL."""

FAULT = (
    "struct<scene:int,t:double,t_end:double,type:string,severity:string,detail:string,votes:string,"
    "item:string,triage:string>"
)
DIALOGUE = "array<struct<speaker:string,text:string>>"
READ_ITEM = (
    f"struct<dialogue:{DIALOGUE},narration_text:string,sfx:string,scene_beat:string,kind:string,quality:string>"
)
SCENE = (
    "struct<narration:string,panels:array<string>,panel:string,pace:string,keywords:array<string>,motion:string,"
    "caption:string,cta:boolean,emphasis:boolean,sfx_events:array<struct<cue:string,word:string,gain:double>>,"
    "ambience:string>"
)
MUSIC_SECTION = "struct<mood:string,from_scene:int,track:string,artist:string,url:string>"
SCRIPT = (
    f"struct<title:string,voice:string,hook_scenes:int,music_plan:array<{MUSIC_SECTION}>,"
    f"source:struct<series:string,chapter:string,mode:string>,scenes:array<{SCENE}>>"
)
